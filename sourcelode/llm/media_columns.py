"""Media columns: interleaved document sequences.

HTML is parsed into ordered items: texts, and references to media with their captions. Media are stored as
8-bit grey PNG images (lossless) in a table keyed by digest. The media items of all sequences are exploded and
meet their stored payload by an equi-join on the digest; then items return to their page in order, so positions
and captions stay beside what they belong to. Payloads never travel: the join carries digests and what was
computed from the bytes read back. Texts travel whole, or as their length and digest (`texts="digest"`).

The query makes each document a page: a heading, the text in paragraphs, and a figure whose image is the stored
text and whose caption names the document. The page is parsed and goes through `interleaved` with text digests;
what it returns for the figure is the result, beside the number of items, and the length and caption found.

Captions: that of a figure belongs to each media item of the figure, before or after it, and goes before the
item's own alt or title. A caption ends with its element or its figure, or where another figure begins; if the page ends
before, its first block is the caption and the rest is text. A caption without media, or outside of a figure, is
a text in its place. No text is lost.

Defined cases: a null html has no items and no sequence; a null or empty text is stored as one block of padding;
references without a stored payload keep their item with null media columns; equal payloads have one stored form
and one row in the join, however many pages refer to it; pages are told apart by row, so repeated pages and null
ids keep a sequence each; items cannot tie, since positions are unique within a page; very long texts and pages
are handled whole, one at a time; an empty table gives no rows; other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import fresh_path, table, written

BLOCK, SIDE, PAD, MAGIC = 576, 24, b"\xff", b"\x89PNG\r\n\x1a\n"
PREFIX = "media:"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
BREAKS = {"p", "div", "figure", "figcaption", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "section", "article"}
HIDDEN = {"script", "style"}
ITEM = [("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("text_chars", pa.int64()), ("ref", pa.string()), ("caption", pa.string())]
ITEM_SQL = "STRUCT<position: INT, kind: STRING, text: STRING, text_chars: BIGINT, ref: STRING, caption: STRING>"


class _Sequence(HTMLParser):
    """Items in order. Each open figure is a list of the items that belong to it; captions are items as well
    until their figure ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.figures: list[list[dict]] = []
        self.caption: list[dict] | None = None  # parts of the open caption
        self.hidden = 0

    def add(self, kind: str, **values) -> dict:
        item = {"kind": kind, "text": None, "ref": None, "caption": None} | values
        self.items.append(item)
        if self.figures and kind != "text":
            self.figures[-1].append(item)
        return item

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text and self.caption is not None:
            self.caption.append(self.add("caption", text=text))
        elif text:
            self.add("text", text=text)

    def end_figure(self) -> None:
        own = self.figures.pop()
        media = [x for x in own if x["kind"] == "media"]
        parts = [x for x in own if x["kind"] == "caption"]
        if not media:
            for part in parts:
                part["kind"] = "text"
        elif parts:
            for item in media:
                item["caption"] = " ".join(x["text"] for x in parts)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BREAKS or tag in MEDIA_TAGS:
            self.flush()
        if tag == "figure":
            self.caption = None
            self.figures.append([])
        if tag == "figcaption" and self.figures:
            self.caption = []
        own = dict(attrs)
        if tag in MEDIA_TAGS and own.get("src"):
            self.add("media", ref=own["src"], caption=own.get("alt") or own.get("title"))

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BREAKS:
            self.flush()
        if tag in ("figcaption", "figure"):
            self.caption = None
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        for part in (self.caption or [])[1:]:  # the page ended inside: what follows the first block is text
            part["kind"] = "text"
        while self.figures:
            self.end_figure()
        return [x for x in self.items if x["kind"] != "caption"]


def parse_html(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    return [{"position": k, **item} for k, item in enumerate(parser.finish())]


def sequences(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", texts: str = "whole") -> DataFrame:
    """page (a number for the row), page_id, items: ordered texts and media references."""
    if texts not in ("whole", "digest"):
        raise ValueError("texts is whole or digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(ITEM))
        for batch in batches:
            for part in blocks(batch, 2):
                pages = []
                for html in part.column(2):
                    items = parse_html(html.as_py())
                    for item in items:
                        if item["text"] is not None:
                            item["text_chars"] = len(item["text"])
                            if texts == "digest":
                                item["text"] = hashlib.sha256(item["text"].encode("utf-8", "surrogatepass")).hexdigest()
                    pages.append(items)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pages, kind)], names=["page", "page_id", "items"])

    rows = pages.select(F.monotonically_increasing_id().alias("page"), pages[id_column].cast("long"), html_column)
    return rows.mapInArrow(run, f"page BIGINT, page_id BIGINT, items ARRAY<{ITEM_SQL}>")


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Grey, 8 bits, SIDE wide, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    raw = np.zeros((len(rows), SIDE + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of an image that to_png made, [rows, SIDE]; checks the chunks' sums."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Integer sums alone, so that it is the same everywhere: sum, eight levels, mean of each quarter of the columns."""
    levels = np.bincount(samples.ravel() >> 5, minlength=8)
    quarters = samples.reshape(len(samples), 4, SIDE // 4).sum(axis=(0, 2), dtype=np.int64) // (len(samples) * SIDE // 4)
    return f"sum={int(samples.sum(dtype=np.int64))};levels={','.join(map(str, levels))};columns={','.join(map(str, quarters))}"


def store_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the media table digest, n_bytes, media of the texts to `path` and returns it read back; without a
    path it goes to this application's part of the shared folder, and goes with the application. A task stores a payload once; copies in other tasks are equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part in blocks(batch, 0):
                rows = []
                for text in part.column(0).to_pylist():
                    n, payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if (digest, n) not in seen:
                        seen.add((digest, n))
                        rows.append((f"{digest}-{n}", n, to_png(payload)))
                kinds = [pa.string(), pa.int64(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n_bytes", "media"])

    path = path or fresh_path(docs.sparkSession, "media")
    stored = docs.select("text").mapInArrow(run, "digest STRING, n_bytes BIGINT, media BINARY")
    stored.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.schema(stored.schema).parquet(path)


MEDIA = "digest STRING, n_bytes BIGINT, payload_bytes BIGINT, payload_sha256 STRING, tail_crc32 BIGINT, media_bytes BIGINT, media_sha256 STRING, feature STRING"


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in MEDIA.split(", ")]
        for batch in batches:
            rows = []
            for digest, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            if rows:
                kinds = [pa.int64() if "BIGINT" in f else pa.string() for f in MEDIA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = media.select("digest", "n_bytes", "media").mapInArrow(run, MEDIA)
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns if c != "digest"])


def resolved(items: DataFrame, media: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Media items (with a column ref) with the media table's columns beside the references it resolves."""
    digest = F.when(F.col("ref").startswith(prefix), F.substring("ref", F.lit(len(prefix) + 1), F.length("ref")))
    return items.withColumn("digest", digest).hint("merge").join(media, "digest", "left")


def interleaved(pages: DataFrame, media: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """page, page_id, items in order, each media item with what resolves it. A page's items are bounded by its html.
    Sequences are written first: they are parsed once, though texts and media go separate ways."""
    pages = written(pages, "sequences")
    items = pages.select("page", "page_id", F.inline("items"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in media.dtypes]
    texts = items.filter("kind = 'text'").select("*", *nothing)
    every = texts.unionByName(resolved(items.filter("kind = 'media'"), media, prefix))
    fields = [name for name, _ in ITEM] + media.columns
    return every.groupBy("page", "page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page: a heading, its text in paragraphs, and the stored text as a figure with a caption."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    room = F.greatest(F.lit(BLOCK), F.ceil(size / BLOCK) * BLOCK)
    payload = F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("FF"), (room - size).cast("int"))))
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit("<h1>document</h1><p>"), F.replace(escaped, F.lit("\n\n"), F.lit("</p><p>")),
        F.lit(f'</p><figure><img src="{PREFIX}'), F.sha2(payload, 256), F.lit("-"), size.cast("string"),
        F.lit('"><figcaption>text of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")),
        F.lit("</figcaption></figure>"),
    )
    return docs.select(docs["doc_id"].cast("long").alias("page_id"), html.alias("html"))


def media_columns(docs: DataFrame) -> DataFrame:
    media = written(read_back(store_texts(docs)), "media-columns")  # so that the join can be split where a digest is hot
    pages = interleaved(sequences(document_pages(docs), texts="digest"), media)
    at = F.filter("items", lambda x: x["kind"] == "media")
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["text_chars"], F.lit(0)))
    found = pages.select("page_id", F.size("items").alias("n_items"), chars.alias("page_chars"), F.inline(at))
    return found.select(
        F.col("page_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "position", "caption", "n_items", "page_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
