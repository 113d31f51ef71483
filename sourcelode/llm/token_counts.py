"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch are laid end to end in one array of symbols. In each round every sequence finds its
lowest-rank pair, all of them are merged at once (leftmost first where they overlap), and only ranks beside
a merged symbol are looked up again; sequences without a pair leave with their count of symbols.

Texts are first cut into segments: a space or line feed and what follows it up to the next one. No pre-token
reaches across such a cut, so segments are numbered in Arrow, each distinct one is counted once, and counts
are summed by text. Texts with longer runs of white space inside, or with the special string, are cut by the
tokenizer's own pattern instead: slower, and as exact.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept; an empty
table gives no rows; pairs that tie in rank are the same pair, and merge from the left; other columns are not
read, and may have any name. Every text is counted whole, in blocks of about 16 MB or one longer text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .bpe import ODD, blocks, byte_symbols, vocabulary_json
from .common import table

VOCABULARY, LIMIT, CACHE, AT_ONCE = "byte_bpe_50k.json", 1024, 300_000, 100_000
NONE = np.int32(2**31 - 1)

_mergers: dict = {}
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merger:
    def __init__(self, model: str):
        import regex

        whole = json.loads(model)
        vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [t["content"] for t in whole["added_tokens"]]
        self.first = np.array([vocabulary[c] for c in byte_symbols()], np.int64)
        self.base = len(vocabulary) + 1
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.pretokens: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each of the words (none of them empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        counts, own = sizes.copy(), np.arange(len(words))  # own: the word of each sequence still at work
        ranks = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = NONE
        while len(own):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            busy = best < NONE
            counts[own[~busy]] = sizes[~busy]
            if not busy.all():
                keep = np.repeat(busy, sizes)
                symbols, ranks, own, sizes, best = symbols[keep], ranks[keep], own[busy], sizes[busy], best[busy]
                if not len(own):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, sizes))
            follows = np.diff(hit, prepend=-2) == 1  # a pair that begins with the end of another: equal symbols
            if follows.any():
                k = np.arange(len(hit))
                run = k - np.maximum.accumulate(np.where(follows, 0, k))
                hit = hit[run % 2 == 0]
            seq = np.repeat(np.arange(len(own)), sizes)
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            last[hit] = last[hit + 1]
            sizes = sizes - np.bincount(seq[hit], minlength=len(own))
            place = np.cumsum(keep) - 1
            symbols, ranks, last, at = symbols[keep], ranks[keep], last[keep], place[hit]
            ranks[at] = NONE
            near = np.unique(np.concatenate((at, at[at > 0] - 1)))
            near = near[~last[near]]
            ranks[near] = self.pair_ranks(symbols[near], symbols[near + 1])
            ranks[last] = NONE
        return counts

    def _count(self, cut: list[list[str]]) -> list[int]:
        known = self.pretokens
        new = list({w for x in cut for w in x if w not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({w for x in cut for w in x})
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            known.update(zip(part, self.merged([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))
        return [sum(map(known.__getitem__, x)) for x in cut]

    def count_segments(self, segments: list[str]) -> np.ndarray:
        missing = [s for s in segments if s not in self.segments]
        if len(self.segments) + len(missing) > CACHE:
            self.segments, missing = {}, segments
        self.segments.update(zip(missing, self._count([self.split(s) for s in missing]), strict=True))
        return np.fromiter(map(self.segments.__getitem__, segments), np.int64, len(segments))

    def count_whole(self, text: str) -> int:
        parts, special = [text], 0
        for s in self.special:
            cut = [p.split(s) for p in parts]
            special += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return special + sum(self._count([self.split(p) for p in parts]))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, ODD))
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
        plain = plain.to_numpy(zero_copy_only=False)
        # each space opens a segment; so does each line feed, behind a space that is not in the text
        body = pc.utf8_rtrim_whitespace(texts)
        lists = pc.split_pattern(pc.replace_substring(body, "\n", " \n"), " ")
        offsets, flat = np.asarray(lists.offsets).astype(np.int64), lists.flatten()
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        numbers, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        bad = np.array([not s or s[-1].isspace() for s in distinct], bool)
        opened = ["" if b else s if s[0] == "\n" else " " + s for s, b in zip(distinct, bad.tolist(), strict=True)]
        each = self.count_segments(opened)
        sums = np.concatenate(([0], np.cumsum(each[numbers])))
        bads = np.concatenate(([0], np.cumsum(bad[numbers])))
        total = np.diff(sums[offsets])
        plain &= np.diff(bads[offsets]) == 0
        heads = numbers[np.minimum(offsets[:-1], max(len(numbers) - 1, 0))] if len(numbers) else np.zeros(len(texts), int)
        tails = (pc.utf8_length(texts).to_numpy(zero_copy_only=False) - pc.utf8_length(body).to_numpy(zero_copy_only=False)).tolist()
        # the first segment has no space before it; what was trimmed is one pre-token
        firsts = {int(n) for n, p in zip(heads, plain, strict=True) if p}
        alone = dict(zip(firsts, self._count([self.split(distinct[n]) for n in firsts]), strict=True))
        for i, p in enumerate(plain.tolist()):
            if not p:
                total[i] = self.count_whole(texts[i].as_py())
            else:
                total[i] += alone[int(heads[i])] - each[heads[i]]
                if tails[i]:
                    total[i] += self._count([[texts[i].as_py()[-tails[i] :]]])[0]
        return total


def merger_of(model: str) -> Merger:
    """One for the process, so that workers that run several tasks merge a pre-token once."""
    key = hash(model)
    if key not in _mergers:
        _mergers[key] = Merger(model)
    return _mergers[key]


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(vocabulary_json(vocabulary))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(model.value)
        for batch in batches:
            for part in blocks(batch, 1):
                n = merger.count(part.column(1))
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                arrays = [part.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        run, "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
