"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIMENSION signs. An n-gram's vector binds its letters' vectors, each
permuted by its place (rolled by 2, 1 and 0), by product; a text's vector bundles those of its n-grams, by
sum; a language's prototype bundles its texts' vectors, each in proportion to the text's n-grams. A text
has the language of the prototype with the greatest cosine.

Bundling is linear in n-gram counts, so texts are counted first (dense over the n-grams that a block of texts
has; blocks are halved until that is at most CELLS numbers or one text) and bound vectors are made once for
each n-gram of the block. Prototypes come from all training
rows: n-gram counts are summed within tasks and then by Spark, bound and summed again, and DIMENSION numbers
a language reach the driver, whatever the input.

Letters: a-z of the lower-cased text, and every other letter by its code point modulo OTHERS (so letters of
different scripts may share a vector, but hardly an n-gram's neighbours); anything else is a gap, and runs of
gaps are one.

The pipeline's stage rejects a text without letters, and one of SURE different n-grams or more whose best cosine is
below CHANCE: four times the deviation that cosines of unrelated vectors of this dimension have. Such a text
has nothing in common with any language learned. Texts of fewer n-grams tell too little to be rejected.

Defined cases: a null text, and one without letters, is `und` with score 0, and so is every text when there
is nothing to learn from (the stage then rejects those without letters alone); ties take the first language
by name; null languages aren't learned; very long texts are counted whole, in a block of their own; an empty
table gives no rows; repeated rows and null ids are kept (a null id is not held out); other columns are not
read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import table

DIMENSION, SEED, OTHERS, BLOCK = 1024, 20240917, 37, 2 << 20
LETTERS = 27 + OTHERS
N_GRAMS = LETTERS**3
UNDETERMINED = "und"
CELLS = 8 << 20
SURE, CHANCE = 50, 4 / DIMENSION**0.5

_made: dict = {}


def letter_table() -> np.ndarray:
    """Code point -> 0 for a gap, 1 to 26 for a to z, above for other letters."""
    if "letters" not in _made:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                out[c] = 27 + c % OTHERS
        out[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _made["letters"] = out
    return _made["letters"]


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSION))


def bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, one a row."""
    v = letter_vectors()
    a, b, c = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def n_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of every n-gram of all texts; a gap is put before and after each text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(("\n" + joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[points]
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    owner = np.concatenate(([0], owner))
    keep = (letters > 0) | np.concatenate(([True], letters[:-1] > 0))
    # each text keeps its own closing gap; the next text's n-grams begin with it
    letters, owner = letters[keep].astype(np.int64), owner[keep]
    codes = letters[:-2] * LETTERS**2 + letters[1:-1] * LETTERS + letters[2:]
    inside = letters[1:-1] > 0
    return owner[1:-1][inside], codes[inside]


def distinct(codes: np.ndarray) -> np.ndarray:
    seen = np.zeros(N_GRAMS, bool)
    seen[codes] = True
    return np.flatnonzero(seen)


def tally(texts: int, owner: np.ndarray, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
    number = np.zeros(N_GRAMS, np.int32)
    number[found] = np.arange(len(found))
    flat = np.bincount(owner * len(found) + number[codes], minlength=texts * len(found)) if len(found) else np.zeros(0)
    return flat.reshape(texts, len(found)).astype(np.float32)


def tallies(texts: list[str], cells: int = CELLS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one after the last, n-grams that occur, counts [text, n-gram]) of parts of the texts, whose
    counts are at most `cells` numbers or those of one text."""
    owner, codes = n_grams(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    work = [(0, len(texts))] if texts else []
    while work:
        a, b = work.pop()
        own = codes[edges[a] : edges[b]]
        found = distinct(own)
        if b - a > 1 and (b - a) * len(found) > cells:
            middle = (a + b) // 2
            work += [(middle, b), (a, middle)]
        else:
            yield a, b, found, tally(b - a, owner[edges[a] : edges[b]] - a, own, found)


def lowered(texts: pa.Array) -> list[str]:
    return [(t or "").lower() for t in texts.to_pylist()]


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most 256 texts, so that the dense counts stay small."""
    for block in blocks(batch, column, BLOCK):
        for at in range(0, block.num_rows, 256):
            yield block.slice(at, 256)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def shares(training: DataFrame) -> DataFrame:
    """training(text, lang) -> lang, code, share: each text adds 1 to its language's shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch, 0):
                langs = part.column(1).to_pylist()
                for a, b, found, counts in tallies(lowered(part.column(0))):
                    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
                    for lang in set(langs[a:b]):
                        own = np.array([x == lang for x in langs[a:b]])
                        sums.setdefault(lang, np.zeros(N_GRAMS))[found] += counts[own].sum(axis=0, dtype=np.float64)
        for lang, s in sums.items():
            code = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(s[code])], names=["lang", "code", "share"])

    each = training.select("text", "lang").mapInArrow(run, "lang STRING, code BIGINT, share DOUBLE")
    return each.groupBy("lang", "code").agg(F.sum("share").alias("share"))


def projected(summed: DataFrame) -> DataFrame:
    """lang, code, share -> lang, dim, value: shares times bound vectors, summed within tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, codes, share = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                for at in range(0, len(own), 8192):
                    part = own[at : at + 8192]
                    sums[lang] = sums.get(lang, 0) + share[part] @ bound(codes[part])
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSION, pa.string()), pa.array(np.arange(DIMENSION)), pa.array(s)], names=["lang", "dim", "value"])

    return summed.mapInArrow(run, "lang STRING, dim BIGINT, value DOUBLE").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and their vectors of length 1 (float32): DIMENSION rows a language reach the driver."""
    rows = projected(shares(training.filter(F.col("lang").isNotNull()))).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    out = np.zeros((len(langs), DIMENSION))
    out[rows["lang"].map(langs.index).to_numpy(np.int64), rows["dim"].to_numpy(np.int64)] = rows["value"].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, (out / np.maximum(norm, 1e-12)).astype(np.float32)


class Profiles:
    """Cosines of texts with prototypes. Bound vectors of n-grams are kept for the process."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        self.langs, self.vectors = langs, vectors

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(different n-grams of each text, cosines [text, language])."""
        n, bundled = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMENSION), np.float32)
        for a, b, found, counts in tallies(texts):
            for at in range(0, len(found), 8192):
                bundled[a:b] += counts[:, at : at + 8192] @ bound(found[at : at + 8192]).astype(np.float32)
            n[a:b] = np.count_nonzero(counts, axis=1)
        norm = np.linalg.norm(bundled, axis=1, keepdims=True)
        return n, (bundled / np.maximum(norm, 1e-12)) @ self.vectors.T

    def kept(self, texts: list[str]) -> np.ndarray:
        """Whether the pipeline's stage keeps each text."""
        n, cosines = self.cosines(texts)
        if not self.langs:
            return n > 0
        return (n > 0) & ((n < SURE) | (cosines.max(axis=1) >= CHANCE))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n, cosines = self.cosines(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = cosines.argmax(axis=1)
        score = np.clip(cosines.max(axis=1), 0, 1)
        return (
            [self.langs[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)],
            [float(s) if k else 0.0 for s, k in zip(score, n, strict=True)],
        )


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score by prototypes of training(text, lang)."""
    known = docs.sparkSession.sparkContext.broadcast(prototypes(training))  # languages x DIMENSION numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(*known.value)
        for batch in batches:
            for part in parts(batch, 1):
                lang, score = profiles.predict(lowered(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(docs["doc_id"].cast("long"), "text")
    return own.mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def _held_out(rows: DataFrame) -> Column:
    return F.coalesce(remainder(rows["doc_id"], 4) == 2, F.lit(False))


def label(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all."""
    out = identify(docs, docs.filter(~_held_out(docs)))
    return out.select("doc_id", _held_out(out).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language known go: see `Profiles.kept`. Whole rows pass through the tasks that tell their
    language, so nothing is joined or exchanged."""
    known = spark.sparkContext.broadcast(prototypes(docs.filter(~_held_out(docs))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(*known.value)
        for batch in batches:
            for part in parts(batch, at):
                yield part.filter(pa.array(profiles.kept(lowered(part.column(at))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
