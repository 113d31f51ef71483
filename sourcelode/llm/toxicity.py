"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the row of its hash bucket; filters of widths 1, 2 and 3 slide over the words, each
filter's maximum over the text is pooled, and a logistic layer scores the pooled values. Buckets that fewer
than MIN_DOCS training texts have share one row that stays zero, so words unknown to training fire nothing.

Training: all labelled documents that are not held out, whole texts. A label counts once, and so does a document
that the table repeats (of rows that repeat an id, the greatest text is the document). The documents are dealt by a
hash of their ids to at most TRAINERS trainers, in an order that hash fixes, and stay there. In each of EPOCHS
rounds every trainer learns from all its documents, a chunk at a time, starting from the same model; the mean of
what they return is the next round's model (a word's row: the mean over the trainers that changed it). Which
words are frequent, and the labels' balance, are counts over all training texts. The driver and each trainer hold
one model (19 MB at most), whatever the table's size; the order of sums is fixed, so the layout of the table does
not reach the model. A fifth of the documents, by another hash, is not trained on and sets a threshold for each
language (that with the best F1, searched over all their scores by running totals); a language of which that fifth
has fewer than CALIBRATES texts of either kind takes the threshold of all languages together. A text's score is
the logistic of its distance to its language's threshold, so 0.5 is the threshold everywhere.
The language is told from the text itself by lists of function words, fixed values for four languages (texts in
others are one more group): the lang column, which op2's profiles are learned from, may not reach a score.

Defined cases: null and empty texts, and texts without words, get the score of an empty pool; without
training texts of both kinds the score is the share of toxic labels (0 without labels); repeated label rows count
once, toxic if any is; very long texts are scored whole, in parts whose maxima are pooled; scores that tie with
the threshold are toxic; an empty table gives no rows; repeated documents and null ids are kept; other columns
are not read, and may have any name.

`sample` and `fit` learn on the driver from bounded rows, to look at a model; no query and no stage calls them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import running_total
from .bpe import blocks
from .common import table, written
from .language_id import remainder

BUCKETS, EMBEDDING, FILTERS, WIDTHS = 1 << 18, 16, 16, (1, 2, 3)
TOXIC, CLEAN, SAMPLE_WORDS, CALIBRATES, MIN_DOCS = 4000, 6000, 20_000_000, 10, 3
EPOCHS, BATCH, RATE, SEED, AT_ONCE, BLOCK = 10, 32, 0.01, 7, 1 << 16, 4 << 20
TRAINERS, PER_TRAINER, CHUNK, CHUNK_WORDS, SLICES, MAX_BITS = 64, 8192, 1024, 4 << 20, 16, 1 << 26
PAD, RARE = 0, 1
NO_WORD = r"[^\p{L}\p{N}_]+"

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les et des en un du une est pour qui dans que par sur pas plus au avec ce",
    "es": "el los y del que las un por con no una para su al lo como más pero sus se",
}
LANGUAGE_OF = {w: k + 1 for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
LANGUAGES = len(FUNCTION_WORDS) + 1


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text and one more, buckets by position, language of each text). Distinct words are
    looked at once a block."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    plain = pc.utf8_trim(pc.replace_substring_regex(low, NO_WORD, " "), " ")
    lists = pc.split_pattern(plain, " ")
    sizes = np.diff(np.asarray(lists.offsets)) - (pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0)
    flat = lists.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()  # a text without words is split into ""
    distinct, numbers = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in distinct), np.int32, len(distinct))
    marks = np.fromiter((LANGUAGE_OF.get(w, 0) for w in distinct), np.int64, len(distinct))
    owner = np.repeat(np.arange(len(texts)), sizes)
    votes = np.bincount(owner * LANGUAGES + marks[numbers], minlength=len(texts) * LANGUAGES).reshape(-1, LANGUAGES)
    votes[:, 0] = 0
    return np.concatenate(([0], np.cumsum(sizes))), buckets[numbers], votes.argmax(axis=1)


@dataclass
class Model:
    rows: np.ndarray  # bucket -> row of the embedding
    embedding: np.ndarray
    filters: list[np.ndarray]  # [width, EMBEDDING, FILTERS]
    shift: np.ndarray  # of all filters
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language

    def windows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Each width's filters at each place; ids end with as many PADs as the widest filter overhangs."""
        x, n = self.embedding[ids], len(ids) - max(WIDTHS) + 1
        out = []
        for k, (width, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            y = self.shift[k * FILTERS : (k + 1) * FILTERS] + x[:n] @ w[0]
            for j in range(1, width):
                y += x[j : n + j] @ w[j]
            out.append(y)
        return out

    def best(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of each filter's maximum in each text (none empty), AT_ONCE windows at a time."""
        at = np.zeros((len(starts), FILTERS * len(WIDTHS)), np.int64)
        most = np.full(at.shape, -np.inf, np.float32)
        ends, overhang = starts + lengths, max(WIDTHS) - 1
        for a in range(0, int(ends[-1]), AT_ONCE):
            b = min(int(ends[-1]), a + AT_ONCE)
            y = np.concatenate(self.windows(ids[a : b + overhang]), axis=1)
            for i in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))):
                c, d = max(int(starts[i]), a), min(int(ends[i]), b)
                place = y[c - a : d - a].argmax(axis=0)
                value = np.take_along_axis(y[c - a : d - a], place[None], axis=0)[0]
                at[i] = np.where(value > most[i], c + place, at[i])
                most[i] = np.maximum(value, most[i])
        return at, most

    def logits(self, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Of texts whose words' buckets are flat[first[i]:first[i + 1]]."""
        pooled = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        ids, starts, lengths = spread(first, self.rows[flat])
        full, overhang, at = np.flatnonzero(lengths), max(WIDTHS) - 1, 0
        ends = starts + lengths
        while at < len(full):  # texts of AT_ONCE words together, or one longer text in parts
            to = max(at + 1, int(np.searchsorted(ends[full], starts[full[at]] + AT_ONCE, side="right")))
            own = full[at:to]
            a, b = starts[own[0]], ends[own[-1]]
            if len(own) == 1:
                for p in range(a, b, AT_ONCE):
                    y = np.concatenate(self.windows(ids[p : min(b, p + AT_ONCE) + overhang]), axis=1)
                    pooled[own[0]] = np.maximum(pooled[own[0]], y.max(axis=0))
            else:
                y = np.concatenate(self.windows(ids[a : b + overhang]), axis=1)
                edges = np.stack([starts[own], ends[own]], axis=1).ravel()[:-1] - a  # every other part lies between texts
                pooled[own] = np.maximum(0, np.maximum.reduceat(y, edges, axis=0)[::2])
            at = to
        return pooled @ self.weights + self.bias


def spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end with PADs behind each, so that no window holds words of two texts: ids, starts, lengths."""
    lengths, gap = np.diff(first), max(WIDTHS) - 1
    starts = np.concatenate(([0], np.cumsum(lengths + gap)))
    ids = np.full(starts[-1] + gap, PAD, np.int32)
    ids[np.arange(len(rows)) + np.repeat(starts[:-1] - first[:-1] + first[0], lengths) - first[0]] = rows
    return ids, starts[:-1], lengths


@dataclass
class State:
    """A model in training: what is learned beside its embedding, Adam's moments of that, and the rows' Adagrad sums."""

    model: Model
    squares: np.ndarray
    moments: dict[str, tuple[np.ndarray, np.ndarray]]
    step: float = 0.0

    def dense(self) -> dict[str, np.ndarray]:
        model = self.model
        own = {f"f{k}": f for k, f in enumerate(model.filters)}
        return own | {"shift": model.shift, "w": model.weights, "b": np.asarray(model.bias)}

    def packed(self) -> np.ndarray:
        own = self.dense()
        parts = [part for name, value in own.items() for part in (value, *self.moments[name])]
        return np.concatenate([*(np.asarray(x, np.float64).ravel() for x in parts), [self.step]])

    def unpacked(self, vector: np.ndarray, embedding: np.ndarray, squares: np.ndarray) -> State:
        at, found, moments = 0, {}, {}
        for name, value in self.dense().items():
            n = value.size
            x, m, v = (vector[at + k * n : at + (k + 1) * n].reshape(value.shape) for k in range(3))
            found[name], moments[name], at = x.astype(np.float32), (m.copy(), v.copy()), at + 3 * n
        filters = [found[f"f{k}"] for k in range(len(WIDTHS))]
        model = Model(self.model.rows, embedding, filters, found["shift"], found["w"], float(found["b"]), self.model.thresholds.copy())
        return State(model, squares, moments, float(vector[at]))

    def own(self) -> State:
        """A copy to learn in."""
        return self.unpacked(self.packed(), self.model.embedding.copy(), self.squares.copy())

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, balance: np.ndarray) -> np.ndarray:
        """One step on texts that have words. Returns the embedding's rows that it changed."""
        model = self.model
        self.step += 1

        def adam(name, value, grad):
            m, v = self.moments[name]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            self.moments[name] = m, v
            return value - RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)

        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        ids, starts, lengths = spread(first, model.rows[np.concatenate(texts)])
        best, most = model.best(ids, starts, lengths)
        pooled = np.maximum(most, 0)
        score = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
        g = ((score - labels) * balance / len(texts)).astype(np.float32)
        g_pool = g[:, None] * model.weights * (pooled > 0)
        g_weights = pooled.T @ g + 1e-4 * model.weights
        g_rows: list[tuple[np.ndarray, np.ndarray]] = []
        for no, width in enumerate(WIDTHS):
            part = slice(no * FILTERS, (no + 1) * FILTERS)
            gp, at = g_pool[:, part], best[:, part]
            g_filter = np.empty_like(model.filters[no])
            for j in range(width):
                word = ids[at + j]
                g_filter[j] = np.einsum("bf,bfe->ef", gp, model.embedding[word])
                g_rows.append((word.ravel(), (gp[:, :, None] * model.filters[no][j].T[None]).reshape(-1, EMBEDDING)))
            model.filters[no] = adam(f"f{no}", model.filters[no], g_filter + 1e-4 * model.filters[no]).astype(np.float32)
        word, grad = np.concatenate([r[0] for r in g_rows]), np.concatenate([r[1] for r in g_rows])
        found, back = np.unique(word, return_inverse=True)
        sums = np.zeros((len(found), EMBEDDING), np.float32)
        np.add.at(sums, back, grad)
        sums[found < 2] = 0
        self.squares[found] += (sums**2).mean(axis=1)
        model.embedding[found] -= 0.1 * sums / np.sqrt(self.squares[found])[:, None]
        model.shift = adam("shift", model.shift, g_pool.sum(axis=0))
        model.weights = adam("w", model.weights, g_weights).astype(np.float32)
        model.bias = float(adam("b", model.bias, g.sum()))
        model.shift = np.minimum(model.shift, 0).astype(np.float32)  # a text of unknown words pools nothing
        return found[sums.any(axis=1)]


def untrained(often: np.ndarray, rng: np.random.Generator) -> State:
    """often: the buckets with a row of their own."""
    rows = np.full(BUCKETS, RARE, np.int32)
    rows[often] = np.arange(len(often)) + 2
    n = FILTERS * len(WIDTHS)
    embedding = rng.normal(0, 0.1, (len(often) + 2, EMBEDDING)).astype(np.float32)
    embedding[:2] = 0
    filters = [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(rows, embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0, np.zeros(LANGUAGES))
    state = State(model, np.full(len(embedding), 1e-2, np.float32), {})
    state.moments = {name: (np.zeros(x.shape), np.zeros(x.shape)) for name, x in state.dense().items()}
    return state


def balanced(labels: np.ndarray, toxic_share: float) -> np.ndarray:
    """Weights by which either kind counts half."""
    return np.where(labels == 1, 0.5 / max(toxic_share, 1e-6), 0.5 / max(1 - toxic_share, 1e-6))


def train(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """Buckets of each text's words, and its label."""
    rng = np.random.default_rng(SEED)
    docs = np.bincount(np.concatenate([np.unique(t) for t in texts]).astype(np.int64), minlength=BUCKETS)
    state, balance = untrained(np.flatnonzero(docs >= MIN_DOCS), rng), balanced(labels, labels.mean())
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            if own := [i for i in order[k : k + BATCH] if len(texts[i])]:
                state.learn([texts[i] for i in own], labels[own], balance[own])
    return state.model


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, default: float) -> float:
    """The cut with the best weighted F1, in the middle of the gap it lies in."""
    if not (labels == 1).any() or not (labels == 0).any():
        return default
    order = np.argsort(-logits)
    s, hit, w = logits[order], (labels * weights)[order], weights[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + hit.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(f1.argmax())
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float((s[k] + below) / 2)


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, weights: np.ndarray) -> Model:
    calibrates = np.arange(len(texts)) % 5 == 0
    model = train([t for t, c in zip(texts, calibrates, strict=True) if not c], labels[~calibrates])
    own = [t for t, c in zip(texts, calibrates, strict=True) if c]
    first = np.concatenate(([0], np.cumsum([len(t) for t in own])))
    logits = model.logits(first, np.concatenate(own))
    y, w, lang = labels[calibrates], weights[calibrates], languages[calibrates]
    overall = best_threshold(logits, y, w, 0.0)
    for k in range(LANGUAGES):
        at = lang == k
        enough = (y[at] == 1).sum() >= CALIBRATES and (y[at] == 0).sum() >= CALIBRATES
        model.thresholds[k] = best_threshold(logits[at], y[at], w[at], overall) if enough else overall
    return model


def chosen(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, words: int) -> tuple[DataFrame, dict[int, int]]:
    """(_id, _toxic of the sample, at most toxic + clean rows; labels of either kind). Only rows not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    first = known.filter("_toxic = 1").orderBy(*order).limit(toxic).unionByName(known.filter("_toxic = 0").orderBy(*order).limit(clean))
    chars = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size"))
    sized = chars.join(F.broadcast(first), F.col("doc_id") == F.col("_id")).groupBy("_id", "_toxic").agg(F.max("_size").alias("_size"))
    left, within = {0: words, 1: words}, []
    for r in sorted(sized.withColumn("_order", order[0]).collect(), key=lambda r: (r["_order"], r["_id"])):  # toxic + clean rows at most
        left[r["_toxic"]] -= r["_size"] // 2 + 1  # a word and its gap have 2 bytes at least
        if left[r["_toxic"]] >= 0:
            within.append((r["_id"], r["_toxic"]))
        else:
            left[r["_toxic"]] = -1
    return docs.sparkSession.createDataFrame(within, "_id BIGINT, _toxic INT"), counts


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, words: int = SAMPLE_WORDS):
    """(buckets of each text, labels, languages, weights, share of toxic labels); at most toxic + clean texts, and
    `words` words of either kind. Of rows that repeat an id, the greatest text is the document."""
    ids, counts = chosen(docs, labels, toxic, clean, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                first, flat, lang = words_of(part.column(1))
                own = [flat[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                arrays = [part.column(0), pa.array(own, pa.binary()), pa.array(lang, pa.int32()), part.column(2)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "buckets", "lang", "toxic"])

    rows = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))  # at most toxic + clean rows
        .groupBy("doc_id", F.col("_toxic").alias("toxic")).agg(F.max("text").alias("text"))
        .select("doc_id", "text", "toxic")
        .mapInArrow(run, "doc_id BIGINT, buckets BINARY, lang INT, toxic INT")
        .toPandas().sort_values("doc_id", key=lambda c: c * 2654435761 % 2**32, kind="stable")
    )
    y = rows["toxic"].to_numpy(np.int64)
    total = sum(counts.values())
    weights = np.where(y == 1, counts.get(1, 0) / max((y == 1).sum(), 1), counts.get(0, 0) / max((y == 0).sum(), 1))
    return [np.frombuffer(b, "<i4") for b in rows["buckets"]], y, rows["lang"].to_numpy(), weights, counts.get(1, 0) / total if total else 0.0


def labelled(labels: DataFrame) -> DataFrame:
    """_id, _toxic: one row for each labelled document that is not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    return known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))


def stored(buckets: np.ndarray) -> bytes:
    return len(buckets).to_bytes(8, "little") + pa.compress(buckets.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def restored(stored: bytes) -> np.ndarray:
    n = int.from_bytes(stored[:8], "little")
    return np.frombuffer(pa.decompress(stored[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b"", "<i4")


def likely(ids: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """The rows of ids whose doc_id known has, and about one in nine of the others, which a join has to drop: one
    bit a hash in a table of 64-bit words, which is broadcast. So most texts without a label are not moved."""
    n = min(MAX_BITS, 8 * total) // 64 + 1

    def place(key: str):
        hashed = F.pmod(F.xxhash64(F.lit(2), key), F.lit(64 * n))
        return F.shiftright(hashed, 6), hashed.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place("_id")
    bits = known.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))  # n rows at most
    word, bit = place("doc_id")
    return ids.join(F.broadcast(bits), word == F.col("_word")).filter(F.getbit("_bits", bit) == 1).select("doc_id", "text")


@contextmanager
def no_shuffles_kept(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is deleted when it ends, so that rounds don't fill the disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def encoded(docs: DataFrame, known: DataFrame, total: int, trainers: int) -> DataFrame:
    """trainer, calibrates, buckets, lang, toxic of every document in known, dealt to its trainer and in order there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                first, flat, lang = words_of(part.column(1))
                own = [stored(flat[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                arrays = [part.column(0), pa.array(own, pa.binary()), pa.array(lang, pa.int32()), part.column(2)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "buckets", "lang", "toxic"])

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    ids = ids.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    texts = likely(ids, known, total).groupBy("doc_id").agg(F.max("text").alias("text"))  # repeats are reduced where they are
    rows = texts.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_toxic").alias("toxic"))
    rows = rows.mapInArrow(run, "doc_id BIGINT, buckets BINARY, lang INT, toxic INT")
    rows = rows.withColumn("order", F.xxhash64("doc_id"))
    rows = rows.withColumn("trainer", F.pmod("order", F.lit(trainers)).cast("int")).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(5)) == 0)
    return rows.repartitionById(trainers, "trainer").sortWithinPartitions("order", "doc_id").select("trainer", "calibrates", "buckets", "lang", "toxic")


def tally(training: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """(Buckets that at least MIN_DOCS training texts have; training texts of either kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 2, np.int64)  # the last two: texts by label
        for batch in batches:
            counts[BUCKETS:] += np.bincount(batch.column(1).to_numpy(), minlength=2)
            for b in batch.column(0).to_pylist():
                counts[np.unique(restored(b))] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], names=["bucket", "n"])

    sums = training.select("buckets", "toxic").mapInArrow(run, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.filter((F.col("n") >= MIN_DOCS) | (F.col("bucket") >= BUCKETS)).toPandas()  # BUCKETS + 2 rows at most
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    return np.sort(bucket[bucket < BUCKETS]), {k: int(n[bucket == BUCKETS + k].sum()) for k in (0, 1)}


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(buckets, labels) of CHUNK texts, or fewer that have CHUNK_WORDS words."""
    texts, labels, words = [], [], 0
    for batch in batches:
        for b, y in zip(batch.column("buckets"), batch.column("toxic").to_pylist(), strict=True):
            own = restored(b.as_py())
            texts.append(own)
            labels.append(y)
            words += len(own)
            if len(texts) == CHUNK or words >= CHUNK_WORDS:
                yield texts, np.array(labels)
                texts, labels, words = [], [], 0
    if texts:
        yield texts, np.array(labels)


def merged(parts: pd.DataFrame) -> pd.DataFrame:
    """The changes of a slice, added in order of the trainers and divided by how many have made them."""
    parts = parts.sort_values("trainer")
    ids = [np.frombuffer(b, "<i4") for b in parts["ids"]]
    found, back = np.unique(np.concatenate(ids), return_inverse=True)
    sums, times, at = np.zeros((len(found), EMBEDDING + 1)), np.zeros(len(found)), 0
    dense = parts["slice"].iloc[0] < 0  # one row of another width
    if dense:
        sums, times = np.zeros((1, len(parts["change"].iloc[0]) // 8)), np.zeros(1)
    for own, change in zip(ids, parts["change"], strict=True):
        to = back[at : at + len(own)]
        sums[to] += np.frombuffer(change, "<f8" if dense else "<f4").reshape(len(own), -1)
        times[to] += 1
        at += len(own)
    mean = (sums / times[:, None]).astype("<f8" if dense else "<f4")
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "ids": [found.astype("<i4").tobytes()], "change": [mean.tobytes()]})


def next_round(training: DataFrame, state: State, toxic_share: float, no: int) -> State:
    """Every trainer learns from all its texts; what comes back is the mean of their models."""
    known = training.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        begin = next((b for b in batches if b.num_rows), None)
        if begin is None:
            return
        base, trainer = known.value, begin.column("trainer")[0].as_py()
        own, rng = base.own(), np.random.default_rng([SEED, no, trainer])
        changed = np.zeros(len(base.squares), bool)
        for texts, labels in chunks(b for group in ([begin], batches) for b in group):
            order, balance = rng.permutation(len(texts)), balanced(labels, toxic_share)
            for k in range(0, len(order), BATCH):
                if some := [i for i in order[k : k + BATCH] if len(texts[i])]:
                    changed[own.learn([texts[i] for i in some], labels[some], balance[some])] = True
        ids = np.flatnonzero(changed)
        change = np.concatenate([own.model.embedding - base.model.embedding, (own.squares - base.squares)[:, None]], axis=1)[ids]
        slices = ids * SLICES // len(changed)
        out = [(-1, np.zeros(1, "<i4"), own.packed().astype("<f8"))]
        out += [(int(k), ids[slices == k].astype("<i4"), change[slices == k].astype("<f4")) for k in np.unique(slices)]
        for k, found, values in out:
            arrays = [pa.array([k], pa.int32()), pa.array([trainer], pa.int32()), pa.array([found.tobytes()]), pa.array([values.tobytes()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["slice", "trainer", "ids", "change"])

    parts = training.mapInArrow(run, "slice INT, trainer INT, ids BINARY, change BINARY")
    with no_shuffles_kept(training.sparkSession):
        rows = parts.groupBy("slice").applyInPandas(merged, "slice INT, ids BINARY, change BINARY").collect()  # one model
    known.destroy()
    embedding, squares, vector = state.model.embedding, state.squares, state.packed()
    for r in rows:
        if r["slice"] < 0:
            vector = np.frombuffer(r["change"], "<f8")
        else:
            ids, change = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["change"], "<f4").reshape(-1, EMBEDDING + 1)
            embedding[ids] += change[:, :-1]
            squares[ids] += change[:, -1]
    return state.unpacked(vector, embedding, squares)


def calibrated(calibrating: DataFrame, model: Model) -> np.ndarray:
    """The thresholds by language, from the scores of all rows."""
    known = calibrating.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0, BLOCK // 4):
                own = [restored(b) for b in part.column(0).to_pylist()]
                first = np.concatenate(([0], np.cumsum([len(t) for t in own])))
                logits = known.value.logits(first, np.concatenate(own)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(-logits)], names=["lang", "toxic", "below"])

    rows = calibrating.select("buckets", "lang", "toxic").mapInArrow(run, "lang INT, toxic INT, below DOUBLE")
    rows = rows.select(F.explode(F.array(F.lit(-1), "lang")).alias("part"), "toxic", "below")  # -1: all languages
    points = written(rows.groupBy("part", "below").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")), "points")
    known.destroy()
    kinds = {r["part"]: r for r in points.groupBy("part").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()}
    enough = {k: r["hits"] for k, r in kinds.items() if min(r["hits"], r["n"] - r["hits"]) >= (1 if k < 0 else CALIBRATES)}
    if -1 not in enough:
        return np.zeros(LANGUAGES)
    spark = points.sparkSession
    totals = F.broadcast(spark.createDataFrame(list(enough.items()), "part INT, toxic BIGINT"))  # a row a language
    sums = running_total(points.join(totals, "part"), "hits", ["below"], "found", ["part"])
    sums = running_total(sums, "n", ["below"], "marked", ["part"])
    f1 = 2 * F.col("found") / (F.col("marked") + F.col("toxic"))
    best = {r["part"]: -r["best"]["above"] for r in sums.groupBy("part").agg(F.max(F.struct(f1.alias("f1"), (-F.col("below")).alias("above"))).alias("best")).collect()}
    cuts = F.broadcast(spark.createDataFrame(list(best.items()), "part INT, cut DOUBLE"))
    after = {r["part"]: r["after"] for r in points.join(cuts, "part").filter("below > cut").groupBy("part").agg(F.min("below").alias("after")).collect()}
    middle = {k: -(cut + after.get(k, cut + 2)) / 2 for k, cut in best.items()}
    return np.array([middle.get(k, middle[-1]) for k in range(LANGUAGES)])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model, and the score of every text where there is none."""
    known = labelled(labels)
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return None, share
    rows = encoded(docs, known, total, min(TRAINERS, -(-total // PER_TRAINER))).persist(StorageLevel.DISK_ONLY)
    training = rows.filter(~F.col("calibrates"))
    often, kinds = tally(training)
    model = None
    if kinds[0] and kinds[1]:
        state = untrained(often, np.random.default_rng(SEED))
        for no in range(EPOCHS):
            state = next_round(training, state, kinds[1] / (kinds[0] + kinds[1]), no)
        model = state.model
        model.thresholds = calibrated(rows.filter("calibrates"), model)
    rows.unpersist()
    return model, share


def scores(texts: pa.Array, model: Model | None, share: float) -> np.ndarray:
    if model is None:
        return np.full(len(texts), share)
    first, flat, lang = words_of(texts)
    return 1 / (1 + np.exp(-np.clip(model.logits(first, flat) - model.thresholds[lang], -30, 30)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    known = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))  # BUCKETS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                out = scores(part.column(1), *known.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.astype(np.float64))], names=["doc_id", "score"])

    out = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id BIGINT, score DOUBLE")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Whole rows pass through the tasks that score them: no join, no exchange."""
    known = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at, BLOCK):
                yield part.filter(pa.array(scores(part.column(at), *known.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)
