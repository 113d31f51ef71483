"""License scans by a positional rare-token index (DataFrame operations only).

Templates are short licence notices. Document frequencies of all template words are counted over the whole
corpus (a table of at most as many rows as templates have words); each template is indexed under its
`RARE` highest-IDF words: word -> (template, position). All index words that a file has are looked up,
the postings of each give template starts (word place minus posting), and starts on which two words agree
are candidates. A candidate counts if the template's mandatory phrases stand at their relative positions.
Base phrases are searched for in every file beside that. Everything is computed within a row: no shuffle
but that of the word counts, no join, and work linear in a file's words.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; a very long text is
scanned whole, in memory that grows with its own words alone; repeated rows and null ids each get their row;
an empty table gives no rows (all frequencies are 0); ties in document frequency are resolved by the word, ties
in score don't matter, since the best is reported; other columns are not read, and may have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, fold_ascii, table, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
RARE = 4

#: Opening wording of public licences and of their customary notices: label, words, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mpl", "subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms", "with or without modification"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["copy modify and or distribute", "with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by", "this work is licensed under a creative commons attribution", ["creative commons attribution"]),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold_ascii(text), SEPARATORS), lambda w: w != "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """Of template words alone, over all rows."""
    present = F.array_intersect(strings(vocabulary()), words_of(text_or_empty(docs)))
    counts = docs.select(F.explode(present).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary(), 0) | {r["w"]: r["count"] for r in counts.collect()}


def rare_words(words: str, df: dict[str, int]) -> list[str]:
    return sorted(set(words.split()), key=lambda w: (df[w], w))[:RARE]


def phrase_starts(words: list[str], phrase: list[str]) -> list[int]:
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def base_places(words: Column, n: Column) -> Column:
    """array<struct<start, label>>: where the phrases stand; all of them end with the same word."""
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i) == "license")

    def places(label: str, phrase: tuple[str, ...]) -> Column:
        k = len(phrase) - 1

        def stands(i):
            out = i >= k
            for j, w in enumerate(phrase[:-1]):
                out = out & F.coalesce(F.get(words, i - (k - j)) == w, F.lit(False))
            return out

        return F.transform(
            F.filter(last, stands), lambda i: F.struct((i - k).cast("long").alias("start"), F.lit(label).alias("label"))
        )

    found = [places(label, phrase) for label, phrase in BASE.items()]
    return F.when(F.array_contains(words, "license"), F.concat(*found))


def template_score(words: Column, hits: Column, looked: Column, template, df) -> Column:
    """The best share of the template's words that a verified candidate start has; null if there is none."""
    _, text, phrases = template
    own = text.split()

    def starts_by(w: str) -> Column:
        at = [i for i, x in enumerate(own) if x == w]
        hit = F.filter(hits, lambda h: h["w"] == w)
        per = F.flatten(F.transform(hit, lambda h: F.array(*[h["i"] - p for p in at])))
        return F.when(F.array_contains(looked, w), per).otherwise(F.array().cast("array<int>"))

    starts = {w: starts_by(w) for w in rare_words(text, df)}
    agreed = F.array_distinct(F.concat(*[F.array_intersect(starts[a], starts[b]) for a, b in combinations(starts, 2)]))
    must = sorted({i + j for p in phrases for i in phrase_starts(own, p.split())[:1] for j in range(len(p.split()))})

    def verified(o):
        out = F.lit(True)
        for j in must:
            out = out & F.coalesce(F.get(words, o + j) == own[j], F.lit(False))
        return out

    def share(o):
        same = F.filter(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda j: F.get(words, o + j) == F.get(strings(own), j))
        return F.size(same) / F.lit(float(len(own)))

    # get() takes no negative place: a start before the text leaves its first words unmatched
    return F.array_max(F.transform(F.filter(F.filter(agreed, lambda o: o >= -must[0]), verified), share))


def scan(docs: DataFrame) -> DataFrame:
    df = document_frequencies(docs)
    by_idf = sorted({w for _, text, _ in TEMPLATES for w in rare_words(text, df)}, key=lambda w: (df[w], w))
    words = F.col("_words")
    out = docs.select("doc_id", words_of(text_or_empty(docs)).alias("_words"))
    out = out.select(
        "doc_id", "_words", F.size(words).alias("_n"),
        F.array_intersect(strings(by_idf), words).alias("_looked"),
    )
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    out = out.select(
        "*",
        F.when(F.size("_looked") > 1, F.filter(placed, lambda h: h["w"].isin(by_idf))).alias("_hits"),
        F.coalesce(base_places(words, F.col("_n")), F.array().cast("array<struct<start:bigint,label:string>>")).alias("_base"),
    )
    scores = [
        F.when(F.col("_hits").isNotNull(), template_score(words, F.col("_hits"), F.col("_looked"), t, df)) for t in TEMPLATES
    ]
    out = out.select(
        "doc_id", "_n", "_base",
        F.filter(
            F.array(*[F.struct(F.lit(t[0]).alias("label"), s.alias("score")) for t, s in zip(TEMPLATES, scores, strict=True)]),
            lambda x: x["score"].isNotNull(),
        ).alias("_templates"),
    )
    base, own = F.transform("_base", lambda x: x["label"]), F.transform("_templates", lambda x: x["label"])
    starts = F.transform("_base", lambda x: x["start"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, own)).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("_templates", lambda x: x["score"])), F.lit(0.0)),
            F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in SQL, word by word: the templates, their phrases and the base ones come from the values above."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for no, (label, words, phrases) in enumerate(TEMPLATES):
        own = words.split()
        must = {i + j for p in phrases for i in phrase_starts(own, p.split())[:1] for j in range(len(p.split()))}
        rows += [f"({no}, {quoted(label)}, {len(own)}, {j}, {quoted(w)}, {j in must})" for j, w in enumerate(own)]
    base = [f"({quoted(label)}, {', '.join(quoted(w) for w in (*phrase, '')[:3])})" for label, phrase in BASE.items()]
    folded = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
tw(t, label, size, j, w, must) AS (VALUES {', '.join(rows)}),
base(label, a, b, c) AS (VALUES {', '.join(base)}),
df AS (SELECT w, count(DISTINCT r) AS n FROM words WHERE w IN (SELECT w FROM tw) GROUP BY w),
ranked AS (
  SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) AS k
  FROM (SELECT DISTINCT t, w FROM tw) LEFT JOIN df USING (w)),
starts AS (
  SELECT r, t, i - j AS o FROM words JOIN tw USING (w) JOIN ranked USING (t, w) WHERE k <= {RARE}
  GROUP BY r, t, i - j HAVING count(DISTINCT w) >= 2),
checked AS (
  SELECT s.r, s.t, s.o, any_value(tw.label) AS label, any_value(tw.size) AS size, count(x.w) AS same
  FROM starts s JOIN tw ON tw.t = s.t LEFT JOIN words x ON x.r = s.r AND x.i = s.o + tw.j AND x.w = tw.w
  GROUP BY s.r, s.t, s.o HAVING bool_and(NOT tw.must OR x.w IS NOT NULL)),
placed AS (
  SELECT r, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM words),
places AS (SELECT r, i, label FROM placed JOIN base ON w = a AND w2 = b AND (c = '' OR w3 = c)),
b AS (
  SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY r),
every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM checked) GROUP BY r),
best AS (SELECT r, max(same / CAST(size AS DOUBLE)) AS score FROM checked GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  greatest(coalesce(best.score, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM docs LEFT JOIN b USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""


ORACLE = oracle()
