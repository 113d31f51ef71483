"""BPE encoding and decoding through a table of distinct words.

Words are what white space separates: the tokenizer drops white space, and neither its normalisation nor
its pattern reaches across it, so a word's ids don't depend on its neighbours (a word may hold several
pre-tokens, or special tokens, which have no white space either).

1. Texts are dealt with in blocks of about BLOCK bytes. A block is split into words and its words are
   numbered: a row of word numbers in order of position, and a request for each distinct word.
2. Requests are exchanged by a hash of the word, those of a block and bucket packed in one row: the table of
   distinct words. Each word is encoded once (while a task's words are fewer than CACHE: buckets are as many
   as the session's shuffle partitions).
3. Ids go back to their block (an equi-join on the block's digest) and by word number to each position.
4. Decoding joins ids to the pieces of the vocabulary by id and puts the pieces together.

A block is known by the digest of its words and ids, so a task that runs again meets its own requests; a block
whose requests are missing is an error. A hot word has one request a block, not one a place.

Defined cases: null and empty texts, and texts of white space, have no tokens and the hash of the empty
string; repeated rows and null ids are kept, one row each; an empty table gives no rows; pairs that tie in rank
are the same pair, and merge from the left; other columns are not read, and may have any name. A very long text
is a block of its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import shuffle_width, table

VOCABULARY, BLOCK, CACHE = "word_bpe_49k.json", 16 << 20, 500_000

#: Unicode's White_Space. Arrow's splitter also takes U+001C to U+001F, which the tokenizer does not.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = "[\\x1c-\\x1f]"
#: Fixed value: the tokenizer's pattern. Words of these characters are normalised by lower case alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*\\Z")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def vocabulary_json(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


_loaded: dict = {}


def tokenizer(model: str):
    """The library's tokenizer of a file's content, kept for the process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Tokenizer.from_str(model)
        _loaded[key].no_truncation()
        _loaded[key].no_padding()
    return _loaded[key]


def pieces_of(tok) -> pa.Array:
    by_id = {i: w for w, i in tok.get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_string())


def piece_table(model: str) -> tuple[pa.Array, pa.Array]:
    """A model's pieces and decimals by id, kept for the process."""
    key = ("pieces", hash(model))
    if key not in _loaded:
        pieces = pieces_of(tokenizer(model))
        _loaded[key] = pieces, pa.array(map(str, range(len(pieces))), pa.large_string())
    return _loaded[key]


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text, one row at least. Behind the last one, memory that Arrow keeps for
    later goes back, so that idle workers hold little."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text and one more, word numbers by position, distinct words)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.utf8_split_whitespace(texts)
    offsets, flat = np.asarray(lists.offsets).astype(np.int64), lists.flatten()
    offsets -= offsets[0]
    odd = pc.match_substring_regex(texts, ODD)
    if pc.any(odd).as_py():
        own = [SPACE.split(t) if o else w.as_py() for t, o, w in zip(texts.to_pylist(), odd.to_pylist(), lists, strict=True)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        flat = pa.array([w for x in own for w in x], pa.large_string())
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, np.asarray(coded.indices), coded.dictionary


class WordTable:
    """Ids of words. A word is cut into pre-tokens, and each pre-token met is merged once by the library's model;
    they are kept for the process and forgotten altogether at CACHE pre-tokens. Words with characters beyond
    plain Latin, whose normalisation is more than lower case, go through the whole tokenizer."""

    def __init__(self, tok):
        self.tok, self.ids = tok, {}
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.specials = [t.content for t in tok.get_added_tokens_decoder().values()]

    def merge(self, pretoken: str) -> bytes:
        symbols = pretoken.encode("utf-8").decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.tok.model.tokenize(symbols)], "<i4").tobytes()

    def pretokens(self, word: str) -> list[str] | None:
        """Of a word of plain Latin; None for others."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha():
                low = word.lower()
                return [low[:-1], low[-1]]
            if any(s in word for s in self.specials):
                return None
        elif not PLAIN.match(word):
            return None
        return self.cut(word.lower())

    def look_up(self, words: list[str]) -> pa.LargeListArray:
        if len(self.ids) > CACHE:
            self.ids = {}
        known, merge, out, odd = self.ids, self.merge, [], []
        for word in words:
            own = self.pretokens(word)
            if own is None:
                odd.append(len(out))
                out.append(b"")
                continue
            found = b""
            for p in own:
                one = known.get(p)
                if one is None:
                    one = known[p] = merge(p)
                found += one
            out.append(found)
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for i, e in zip(part, self.tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<i4").tobytes()
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4)))
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))


def word_table(model: str) -> WordTable:
    """One for the process: workers that run several tasks merge a pre-token once."""
    key = ("words", hash(model))
    if key not in _loaded:
        _loaded[key] = WordTable(tokenizer(model))
    return _loaded[key]


def ragged(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def joined(offsets: np.ndarray, numbers: np.ndarray, ids: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
    """(first id of each text and one more, ids by position)."""
    lengths = np.diff(np.asarray(ids.offsets))
    before = np.concatenate(([0], np.cumsum(lengths[numbers])))
    return before[offsets], np.asarray(ids.take(pa.array(numbers)).flatten())


def local_ids(texts: pa.Array, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts through a word table of this process alone."""
    offsets, numbers, distinct = split_words(texts)
    return joined(offsets, numbers, words.look_up(distinct.to_pylist()))


def sha256(values: pa.Array) -> list[str]:
    return [hashlib.sha256(memoryview(v.as_buffer())).hexdigest() for v in values]


def spaced(offsets: np.ndarray, strings: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), strings), pa.scalar(" ", strings.type))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart (high bytes are mostly zero), compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _key(distinct: pa.Array, doc_ids: pa.Array) -> bytes:
    """Of a block's words and ids: copies of a text in other blocks have a key of their own."""
    digest = hashlib.blake2b("\n".join(distinct.to_pylist()).encode("utf-8", "surrogatepass"), digest_size=16)
    digest.update(str(doc_ids.to_pylist()).encode())
    return digest.digest()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, 1):
            offsets, numbers, distinct = split_words(part.column(1))
            arrays = [
                pa.array([_key(distinct, part.column(0))], pa.binary()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([_pack(np.diff(offsets))], pa.binary()), pa.array([_pack(numbers)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "doc_ids", "lengths", "numbers"])


def positions(docs: DataFrame) -> DataFrame:
    own = docs.select(docs["doc_id"].cast("long"), "text")
    return own.mapInArrow(_positions, "block BINARY, doc_ids ARRAY<BIGINT>, lengths BINARY, numbers BINARY")


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct words, those of a bucket (by a hash of the word) in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in blocks(batch, 1):
                distinct = split_words(part.column(1))[2]
                words, key, rows = distinct.to_pylist(), _key(distinct, part.column(0)), []
                of = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
                order = np.argsort(of, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                    text = "\n".join([words[i] for i in own.tolist()])
                    rows.append((int(of[own[0]]), key, _pack(own), squeeze(text.encode("utf-8", "surrogatepass"))))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "numbers", "words"])

    own = docs.select(docs["doc_id"].cast("long"), "text")
    return own.mapInArrow(run, "bucket INT, block BINARY, numbers BINARY, words BINARY")


def encoded(requested: DataFrame, buckets: int, model) -> DataFrame:
    """The table of distinct words: all requests for a word meet in one task, which encodes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, unpack = word_table(model.value), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(batch.num_rows):
                words = unpack(batch.column(3)[at].as_py()).decode("utf-8", "surrogatepass").split("\n")
                ids = table_.look_up(words)
                arrays = [batch.column(1).slice(at, 1), batch.column(2).slice(at, 1), pa.array([_pack(np.diff(np.asarray(ids.offsets)))], pa.binary()), pa.array([_pack(np.asarray(ids.values))], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "numbers", "lengths", "ids"])

    return requested.repartition(buckets, "bucket").mapInArrow(run, "block BINARY, numbers BINARY, lengths BINARY, ids BINARY")


def word_ids(answers: list[dict]) -> tuple[np.ndarray, pa.LargeListArray]:
    """(numbers, ids of each) of a block's answers."""
    numbers = [_unpack(a["numbers"]) for a in answers]
    lengths, ids = [_unpack(a["lengths"]) for a in answers], [_unpack(a["ids"]) for a in answers]
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum(flat(lengths), dtype=np.int64)))
    return flat(numbers), pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat(ids), pa.int32()))


def encode_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    model = docs.sparkSession.sparkContext.broadcast(vocabulary_json(vocabulary))  # a file of fixed size

    def join(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pieces, decimals = piece_table(model.value)
        numbers, ids = word_ids(answers.select(["numbers", "lengths", "ids"]).to_pylist())
        order = np.unique(numbers, return_index=True)[1]  # blocks of the same words ask alike
        ids, out = ids.take(pa.array(order)), []
        for row in rows.to_pylist():
            offsets, at = np.concatenate(([0], np.cumsum(_unpack(row["lengths"]), dtype=np.int64))), _unpack(row["numbers"])
            if len(at) and int(at.max()) >= len(order):
                raise RuntimeError("a block's requests are missing: its input was not read alike twice")
            first, flat = joined(offsets, at, ids)
            for a in range(0, len(row["doc_ids"]), 500):
                own = first[a : a + 501]
                part = pa.array(flat[own[0] : own[-1]])
                # tokens that are in no vocabulary can't come up; the library has no decoder here and joins by a space
                text, digits = spaced(own - own[0], pieces.take(part)), spaced(own - own[0], decimals.take(part))
                out.append(pa.table({"doc_id": pa.array(row["doc_ids"][a : a + 500], pa.int64()), "n_tokens": np.diff(own).astype(np.int64), "ids_sha256": sha256(digits), "decoded_sha256": sha256(text)}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids_sha256": pa.array([], pa.string()), "decoded_sha256": pa.array([], pa.string())})

    buckets = shuffle_width(docs.sparkSession)
    answers = encoded(requests(docs, buckets), buckets, model)
    return positions(docs).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        join, "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"))
