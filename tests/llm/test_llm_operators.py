"""Each operator against a brute-force version, over odd rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcelode.llm import bpe, exact_dedup, language_id, license_scan, media_columns, packing, sharding, simhash, token_counts, toxicity
from sourcelode.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def fold(text):
    return (text or "").translate(FOLD)


@cache
def library(name):
    return Tokenizer.from_str(bpe.vocabulary_json(name))


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- exact dedup -------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(fold(r[1]).encode()).hexdigest()].append(r[0])
    expected = Counter()
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            expected[(i, keep, len(ids), i == keep, digest)] += 1
    assert by_row(exact_dedup.label(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.label(no_docs).collect() == []


def session_with(spark, width):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", str(width))
    return other


def test_index_takes_batches_in_several_sessions(spark, tmp_path):
    """Three sessions of different widths, one batch each: the last state is that of all rows in one batch."""
    schema, path = "doc_id LONG, text STRING", str(tmp_path / "index")
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, f"T{rng.randint(0, 60)}", f"t{rng.randint(0, 60)}", "hot"])) for _ in range(600)]
    seen = defaultdict(list)
    for width, part in zip((4, 8, 3), (rows[:150], rows[150:400], rows[400:]), strict=True):
        session = session_with(spark, width)
        index = exact_dedup.DigestIndex(session, path, 4 if width == 4 else None)
        assert index.buckets == 4
        for i, t in part:
            seen[fold(t)].append(i)
        got = by_row(exact_dedup.ingest(session.createDataFrame(part, schema), index), "doc_id", "digest", "keep_id", "group_size")
        expected = Counter()
        for i, t in part:
            ids = seen[fold(t)]
            expected[i, hashlib.sha256(fold(t).encode()).hexdigest(), max((x for x in ids if x is not None), default=None), len(ids)] += 1
        assert got == expected
        assert session.table(index.name).filter("new").count() == len(seen)  # each digest is new once
        index.close()
    last = exact_dedup.DigestIndex(session_with(spark, 16), path)
    assert by_row(last.state(), "digest", "keep_id", "group_size") == Counter(
        (hashlib.sha256(t.encode()).hexdigest(), max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in seen.items()
    )
    last.close()


def test_known_digests_stay_known_at_any_width(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id LONG, text STRING")
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.ingest(texts, index)
    index.close()
    wide = session_with(spark, 8)
    again = exact_dedup.DigestIndex(wide, path, 8)
    groups = exact_dedup.grouped(exact_dedup.digests(wide.createDataFrame(texts.collect(), texts.schema)))
    assert again.unseen(groups).count() == 0
    again.close()


def test_joins_exchange_the_batch_alone(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), 4)
    batch = spark.createDataFrame([(1, "a")], "doc_id LONG, text STRING")
    exact_dedup.ingest(batch, index)
    path = str(tmp_path / "groups")
    exact_dedup.grouped(exact_dedup.digests(batch)).write.parquet(path)
    for joined in (index.unseen(spark.read.parquet(path)), index.seen(spark.read.parquet(path))):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in index.state()._jdf.queryExecution().executedPlan().toString()
    index.close()


STAGE_ROWS = [
    (1, "same", 0), (1, "same", 0), (2, "x", 0), (2, "y", 0), (3, "y", 0), (3, "Y", 1), (None, "lone", 0), (None, "lone", 0), (4, None, 0), (5, "", 0),
]


@pytest.mark.parametrize("names", ["doc_id LONG, text STRING, _kept LONG", "doc_id LONG, text STRING, k0 LONG", "doc_id LONG, text STRING, row LONG"])
def test_stage_keeps_one_row_of_each_text(spark, names):
    out = exact_dedup.stage(spark, spark.createDataFrame(STAGE_ROWS, names), "")
    assert out.columns == [x.split()[0] for x in names.split(", ")]
    got = Counter(tuple(r) for r in out.collect())
    assert got in [Counter([(1, "same", 0), (2, "x", 0), last, (None, "lone", 0), (5, "", 0)]) for last in [(3, "y", 0), (3, "Y", 1)]]


def test_hot_repeated_rows_leave_one(spark):
    rows = [(7, "hot")] * 500 + [(i, f"own {i}") for i in range(100, 200)]
    out = exact_dedup.stage(spark, spark.createDataFrame(rows, "doc_id LONG, text STRING"), "")
    assert by_row(out, "doc_id", "text") == Counter(set(rows))
    out = simhash.stage(spark, spark.createDataFrame([(7, "hot text here again")] * 500 + [(9, "another text of its own")], "doc_id LONG, text STRING"), "")
    assert by_row(out, "doc_id") == Counter([(7,), (9,)])


def test_near_dedup_stage_keeps_one_row_of_each_component(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, "same"), (1, "same"), (2, base), (2, base + " end"), (3, base), (None, None), (None, ""), (4, "other words")]
    out = simhash.stage(spark, spark.createDataFrame(rows, "doc_id LONG, text STRING"), "")
    got = Counter((r["doc_id"], (r["text"] or "")[:4]) for r in out.collect())
    assert got == Counter([(1, "same"), (2, "word"), (None, ""), (4, "othe")])


# --- sharding ----------------------------------------------------------------------------------------------


def check_shards(out, rows, shards=8):
    got = out.collect()
    assert len(got) == len(rows)
    text_of, sizes, slots, home = {}, Counter(), defaultdict(list), {}
    for r in rows:
        text_of.setdefault(r[0], []).append(r[1] or "")
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        assert any(len(t.encode()) + 1 == r["size"] and zlib.crc32(t.encode()) == r["text_crc32"] for t in text_of[r["doc_id"]])
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_sharding(docs, rows):
    check_shards(sharding.shard(docs), rows)


def test_shards_are_near_equal(spark):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(4000)]
    sizes = check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING")), rows)
    assert max(sizes.values()) <= 1.01 * min(sizes.values())


def test_sharding_with_a_hot_group(spark):
    rows = [(i, "the same text in a third of all rows" if i % 3 == 0 else f"text {i} of its own, some words") for i in range(3000)]
    sizes = check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING")), rows)
    others = sorted(sizes.values())[:-1]
    assert len(sizes) == 8 and others[-1] <= 1.05 * others[0]


def test_a_warm_group_beside_a_hot_one(spark):
    """The hot text has most of the bytes; the warm one is over a fair share of what is left alone."""
    rows = [(i, "hot " * 50) for i in range(9000)] + [(i, "warm" * 50) for i in range(10000, 11700)] + [(i, f"text {i} of its own " * 10) for i in range(20000, 27000)]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    keys = sharding.keyed(table)
    assert len(sharding.large_groups(keys, sum(len(t) + 1 for _, t in rows), 8)) == 2
    sizes = sorted(check_shards(sharding.shard(table), rows).values())
    assert sizes[5] <= 1.02 * sizes[0]


def test_repeats_of_one_row_are_spread_over_lanes(spark):
    rows = [(1, "one row")] * 3000
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id LONG, text STRING")), rows)
    assert sharding.keyed(spark.createDataFrame(rows, "doc_id LONG, text STRING")).select("lane").distinct().count() > 1000
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id LONG, text STRING")), rows, packing.CAPACITY)


def test_splitters_refine_to_single_keys(spark):
    keys = spark.createDataFrame([(k, 10) for k in range(64)], "key LONG, size LONG")  # one interval of the first rounds
    cuts = sharding.splitters(keys, [160.0, 320.0, 480.0], 0)
    assert cuts == [16, 32, 48]


def test_sharding_of_nothing(no_docs):
    assert sharding.shard(no_docs).collect() == []


# --- license scan ------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text, df):
    words = WORD.findall(fold(text))
    places = [(i, label) for label, phrase in license_scan.BASE.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    labels, best = {label for _, label in places}, 0.5 if places else 0.0
    for label, template, phrases in license_scan.TEMPLATES:
        own = template.split()
        rare = license_scan.rare_words(template, df)
        at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: B023, E731
        for o in range(-len(own), len(words)):
            agree = {w for w in rare if any(own[j] == w and at(o + j) == w for j in range(len(own)))}
            must = {i + j for p in phrases for i in license_scan.phrase_starts(own, p.split())[:1] for j in range(len(p.split()))}
            if len(agree) >= 2 and all(at(o + j) == own[j] for j in must):
                labels.add(label)
                best = max(best, sum(at(o + j) == own[j] for j in range(len(own))) / len(own))
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(best, 9)


def test_license_scan(spark, docs, rows):
    more = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "x is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files mit license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Redistribution and use in source and binary forms, with or without modification", "licensed under the gnu lesser general public license",
        "license " * 50 + "mit license", "apache license version 2.0 licensed under the apache license version 2 0",
    ]
    every = [*[(r[0], r[1]) for r in rows], *[(1000 + i, t) for i, t in enumerate(more)]]
    table = spark.createDataFrame(every, "doc_id LONG, text STRING").repartition(3)
    df = license_scan.document_frequencies(table)
    assert df["license"] == sum("license" in WORD.findall(fold(t)) for _, t in every)
    expected = Counter((i, *brute_license(t, df)) for i, t in every)
    got = Counter((*r[:7], round(r["score"], 9)) for r in license_scan.scan(table).collect())
    assert got == expected
    labels = {r["doc_id"]: r["labels"] for r in license_scan.scan(table).collect()}
    assert labels[1000] == "mit" and labels[1003] == "bsd" and "lgpl" in labels[1004]


def test_license_scan_of_all_notices(spark):
    """A third-party-notices file: every index word is in it, and a template's may be the most frequent of all."""
    notices = [words for _, words, _ in license_scan.TEMPLATES]
    texts = [" zz ".join(notices), " zz ".join(reversed(notices)), *notices, *["licensed under the gnu general public license version 2 0 3"] * 5]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    df = license_scan.document_frequencies(table)
    assert len({w for t in notices for w in license_scan.rare_words(t, df)}) > 24
    found = license_scan.scan(table).collect()
    assert Counter((*r[:7], round(r["score"], 9)) for r in found) == Counter((i, *brute_license(t, df)) for i, t in enumerate(texts))
    every = ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))
    assert [r["labels"] for r in sorted(found)[:2]] == [every, every]


def test_license_scan_of_nothing(no_docs):
    assert license_scan.scan(no_docs).collect() == []


def test_license_sql(spark, docs, rows, tmp_path):
    import duckdb

    notices = " zz ".join(words for _, words, _ in license_scan.TEMPLATES)
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate([notices, notices.upper(), "x " + notices[40:], notices[:700]])], "doc_id LONG, text STRING")
    table = docs.select("doc_id", "text").unionByName(more)
    table.write.parquet(str(tmp_path / "documents"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = [tuple(r) for r in license_scan.scan(spark.read.parquet(str(tmp_path / "documents"))).collect()]
    assert Counter(got) == Counter(base.execute(license_scan.ORACLE).fetchall())


# --- simhash -----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(docs, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    parts = brute_components(prints, [r[0] for r in rows])
    expected = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, parts, strict=True))
    assert by_row(simhash.label(docs), "doc_id", "fingerprint", "component_id") == expected


def test_simhash_agrees_with_spark_xxhash64(spark):
    texts = ["one two three", "Ä b c", "x" * 100 + " y z"]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").selectExpr("xxhash64(lower(t)) AS h").collect()
    assert [r["h"] % 2**64 for r in got][0] == simhash.fingerprint(texts[0]) % 2**64


@pytest.mark.parametrize(("plan", "bucket"), [(None, 2), (None, 64), ([(list(range(32)), 1), (list(range(32, 64)), 0)], 3), ([(list(range(64)), 2)], 64)])
def test_links_keep_every_component(spark, bucket, plan):
    """With buckets all too large, all small enough, and each kind of threshold."""
    rng = random.Random(bucket)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:6]:  # crowds of near copies
        for _ in range(15):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(simhash.signed(p) for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp LONG")
    if plan is None:
        n, pairs = simhash.bit_statistics(table)
        assert n == len(prints)
        bits = np.array([[p >> b & 1 for b in range(64)] for p in prints])
        assert (pairs == bits.T @ bits).all()
        plan = simhash.plan(n, pairs)
        assert sum(t + 1 for _, t in plan) == 3
    found = {r["node"]: r["component"] for r in components(simhash.links(table, plan, bucket=bucket)).collect()}
    assert [found.get(p, p) for p in prints] == brute_components(prints, prints)


def test_thresholds_are_unequal_where_buckets_would_fill():
    """Of evenly spread, independent bits: keys grow with the number of fingerprints."""

    def chosen(n):
        pairs = np.full((64, 64), n / 4)
        np.fill_diagonal(pairs, n / 2)
        return sorted((len(g), t) for g, t in simhash.plan(n, pairs))

    assert chosen(10**6) == [(21, 0), (21, 0), (22, 0)]
    assert chosen(10**9) == [(32, 0), (32, 1)]
    assert chosen(10**12) == [(64, 2)]


def test_simhash_of_nothing(no_docs):
    assert simhash.label(no_docs).collect() == []


def test_components_of_a_hot_node(spark):
    """A star of more links than a cold node may have, hung on a path."""
    edges = [(1000 + i, 5) for i in range(300)] + [(i, i + 1) for i in range(5)] + [(7000, 7001)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert {found[1000 + i] for i in range(300)} == {0} and found[7001] == 7000


def test_components_of_a_path_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(9))


# --- tokens ------------------------------------------------------------------------------------------------


def test_bpe_table(docs, rows):
    tok = library(bpe.VOCABULARY)
    expected = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        expected[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert by_row(bpe.encode_table(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_two_vocabularies_in_one_process(docs):
    """Pieces belong to their vocabulary."""
    first, other = (bpe.piece_table(bpe.vocabulary_json(v))[0] for v in (bpe.VOCABULARY, token_counts.VOCABULARY))
    assert not first.equals(other) and bpe.piece_table(bpe.vocabulary_json(bpe.VOCABULARY))[0].equals(first)


def test_bpe_blocks_of_equal_words(spark, monkeypatch):
    """Copies of a text in blocks of their own, and repeated rows."""
    monkeypatch.setattr(bpe.blocks, "__defaults__", (8,))
    rows = [(i, "the same words again") for i in range(30)] + [(3, "the same words again")] * 3
    tok = library(bpe.VOCABULARY)
    n = len(tok.encode(rows[0][1], add_special_tokens=False).ids)
    out = bpe.encode_table(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4))
    assert by_row(out, "doc_id", "n_tokens") == Counter((i, n) for i, _ in rows)


def test_bpe_of_nothing(no_docs):
    assert bpe.encode_table(no_docs).collect() == []


texts = st.text(alphabet=st.sampled_from(" \n\t\r'sabtZ1!.,é́\xa0<>|　\x1f\x85İΣß²ǅ🎉日 "), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    tok, words = library(bpe.VOCABULARY), bpe.word_table(bpe.vocabulary_json(bpe.VOCABULARY))
    first, flat = bpe.local_ids(pa.array(texts), words)
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_counts_equal_the_library(texts):
    tok, merger = library(token_counts.VOCABULARY), token_counts.merger_of(token_counts.vocabulary_json(token_counts.VOCABULARY))
    assert merger.count(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_rank_synchronous_merge_of_runs():
    tok, merger = library(token_counts.VOCABULARY), token_counts.merger_of(token_counts.vocabulary_json(token_counts.VOCABULARY))
    words = ["a" * n for n in range(1, 60)] + ["ha" * n for n in range(1, 30)] + ["x"]
    assert merger.merged([w.encode() for w in words]).tolist() == [len(tok.encode(w, add_special_tokens=False).ids) for w in words]


def test_token_counts(docs, rows):
    tok = library(token_counts.VOCABULARY)
    expected = Counter()
    for r in rows:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        expected[(r[0], len((r[1] or "").encode()), n, n > 1024)] += 1
    assert by_row(token_counts.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_token_counts_of_nothing(no_docs):
    assert token_counts.count_tokens(no_docs).collect() == []


# --- packing -----------------------------------------------------------------------------------------------


def check_packing(out, rows, capacity):
    tok = library(packing.VOCABULARY)
    expected, filled = Counter(), defaultdict(list)
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            cut = ids[k : k + capacity]
            expected[(r[0], k // capacity, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    got = out.collect()
    assert Counter(tuple(r[:5]) for r in got) == expected
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled), sum(r["length"] for r in got)


def test_packing(docs, rows):
    n, total = check_packing(packing.pack(docs), rows, packing.CAPACITY)
    assert n == -(-total // packing.CAPACITY)


def test_packing_into_small_sequences(docs, rows):
    n, total = check_packing(packing.pack(docs, 64), rows, 64)
    assert n <= 1.02 * -(-total // 64) + 1


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 6), max_size=6), st.integers(0, 40))
def test_fullest_combination(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    chosen = packing.fullest(counts, room)
    assert sum(k * n for k, n in chosen.items()) == max(sums) and all(n <= counts[k] for k, n in chosen.items())


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=20))
def test_combinations_use_every_piece_once(histogram):
    used = Counter()
    for times, chosen in packing.combinations(histogram, 50):
        assert sum(k * n for k, n in chosen.items()) <= 50
        for k, n in chosen.items():
            used[k] += times * n
    assert used == Counter(histogram)


# --- language ----------------------------------------------------------------------------------------------


def test_language_id(docs, rows):
    out = language_id.label(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    texts, langs = {r[0]: r[1] for r in rows if r[0] is not None}, {r[0]: r[2] for r in rows if r[0] is not None}
    right = total = 0
    for r in out:
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        has_letter = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
        if r["held_out"] and len(texts[r["doc_id"]] or "") > 60 and langs[r["doc_id"]]:
            total += 1
            right += r["lang_pred"] == langs[r["doc_id"]]
    assert total > 10 and right >= 0.9 * total


def plain_bundle(text):
    """A text's vector, n-gram by n-gram, and the number of its n-grams."""
    letters = [0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in (text or "").lower()]
    runs = [0]
    for x in [*letters, 0]:
        if x or runs[-1]:
            runs.append(x)
    v, total, n = language_id.letter_vectors().astype(int), np.zeros(language_id.DIMENSION), 0
    for a, b, c in zip(runs, runs[1:], runs[2:], strict=False):
        if b:
            total += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
            n += 1
    return total, n


def test_vectors_of_a_text_are_bound_and_bundled():
    texts = ["über ab, a", "", "zz", "日本語", "one two three"]
    for cells in (language_id.CELLS, 8):
        done = 0
        for a, b, found, counts in language_id.tallies(texts, cells):
            assert a == done
            for k, t in enumerate(texts[a:b]):
                assert np.allclose(counts[k] @ language_id.bound(found), plain_bundle(t)[0]) and counts[k].sum() == plain_bundle(t)[1]
            done = b
        assert done == len(texts)


def test_language_id_equals_the_plain_version(docs, rows):
    bundles = [plain_bundle(r[1]) for r in rows]
    protos = {}
    for r, (v, n) in zip(rows, bundles, strict=True):
        if r[2] is not None and n and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2):
            protos[r[2]] = protos.get(r[2], 0) + v / n
    expected = defaultdict(list)
    for r, (v, n) in zip(rows, bundles, strict=True):
        cosines = {x: v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12) for x, p in protos.items()}
        expected[r[0]].append((cosines, n))
    for r in language_id.label(docs).collect():
        fits = False
        for cosines, n in expected[r["doc_id"]]:
            best = max(cosines.values())
            right = r["lang_pred"] == "und" if not n else cosines.get(r["lang_pred"], -2) >= best - 1e-5
            fits |= bool(right and abs(r["score"] - (max(best, 0) if n else 0)) < 1e-4)
        assert fits, r


def test_language_stage_rejects_what_no_profile_fits(spark, docs, rows):
    chinese = "".join(random.Random(1).choices("中文字符测试语言识别随机样本没有拉丁字母一二三四五六七八九十", k=300))
    odd = [(2000, chinese, None), (2001, "中文", None), (2002, "12 34", None), (2003, rows[40][1] * 3, None)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id LONG, text STRING, lang STRING"))
    kept = by_row(language_id.stage(spark, table, ""), "doc_id")
    assert [kept[(i,)] for i in (2000, 2001, 2002, 2003)] == [0, 1, 0, 1]
    expected = Counter((r[0],) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert kept - Counter([(2001,), (2003,)]) == expected


def test_language_id_without_training(docs, no_docs):
    assert language_id.label(no_docs).collect() == []
    out = language_id.identify(docs, no_docs).collect()
    assert {r["lang_pred"] for r in out} == {"und"} and {r["score"] for r in out} == {0.0}


# --- media -------------------------------------------------------------------------------------------------


def plain_png(payload):
    """24 wide, 8-bit grey, made chunk by chunk."""
    raw = b"".join(b"\0" + payload[k : k + 24] for k in range(0, len(payload), 24))
    out = b"\x89PNG\r\n\x1a\n"
    for kind, data in ((b"IHDR", (24).to_bytes(4, "big") + (len(payload) // 24).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(raw, 1)), (b"IEND", b"")):
        out += len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return out


def plain_feature(payload):
    levels = Counter(b // 32 for b in payload)
    columns = [[b for k, b in enumerate(payload) if k % 24 // 6 == q] for q in range(4)]
    return f"sum={sum(payload)};levels={','.join(str(levels[k]) for k in range(8))};columns={','.join(str(sum(c) // len(c)) for c in columns)}"


def plain_paragraphs(text):
    return [" ".join(p.split()) for p in (text or "").split("\n\n") if p.split()]


def test_media_columns(spark, docs, rows):
    """All columns, of the odd rows and of texts that look like HTML, have paragraphs, and repeat."""
    more = [(900, "a <b>bold</b> & brave\n\n</p><figure>x\n\n \n\nend &amp; <script>y", *rows[0][2:]), (901, "same", *rows[0][2:]), (902, "same", *rows[0][2:]), (901, "same", *rows[0][2:])]
    expected = Counter()
    for r in [*rows, *more]:
        data = (r[1] or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        media, parts = plain_png(padded), plain_paragraphs(r[1])
        caption = f"text of document {'without id' if r[0] is None else r[0]}"
        expected[
            (r[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(media), hashlib.sha256(media).hexdigest(), plain_feature(padded))
            + (1 + len(parts), caption, 2 + len(parts), 8 + sum(map(len, parts)))
        ] += 1
    out = media_columns.media_columns(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature position caption n_items page_chars"
    assert by_row(out, *names.split()) == expected


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=0, max_size=2000))
def test_png_keeps_every_byte(data):
    payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
    assert media_columns.from_png(media_columns.to_png(payload)).tobytes() == payload


def test_damaged_media_are_noticed():
    media = bytearray(media_columns.to_png(b"x" * 576))
    media[45] ^= 1
    with pytest.raises(ValueError):
        media_columns.from_png(bytes(media))


def test_interleaved_sequences(spark):
    html = '<p>one <b>two</b></p><img src="media:aa" alt="first"><figure><img src="media:bb"><img src="media:zz"><figcaption>Both &amp; more</figcaption></figure><script>no</script>end'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain"), (1, None), (3, "plain"), (None, "lost?")], "page_id LONG, html STRING")
    media = spark.createDataFrame([("aa", 1), ("bb", 2)], "digest STRING, size INT")
    for texts in ("whole", "digest"):
        out = defaultdict(list)
        for r in media_columns.interleaved(media_columns.sequences(pages, texts=texts), media).collect():
            out[r["page_id"]].append(r["items"])
        named = lambda t: t if texts == "whole" or t is None else hashlib.sha256(t.encode()).hexdigest()  # noqa: B023, E731
        assert [(i["kind"], i["text"], i["text_chars"], i["caption"], i["size"]) for i in out[1][0]] == [
            ("text", named("one two"), 7, None, None), ("media", None, None, "first", 1), ("media", None, None, "Both & more", 2), ("media", None, None, "Both & more", None), ("text", named("end"), 3, None, None)
        ]
        assert [[i["text"] for i in x] for x in out[3]] == [[named("plain")]] * 2 and len(out[1]) == 1 and 2 not in out and len(out[None]) == 1


@pytest.mark.parametrize(("html", "expected"), [
    ("<figure><figcaption>lost</figcaption></figure>", [("text", "lost", None)]),
    ("<figcaption>outside</figcaption>after", [("text", "outside", None), ("text", "after", None)]),
    ('<figure><img src="a"><figcaption>cap<p>later</p>and <b>more</b>', [("media", None, "cap"), ("text", "later", None), ("text", "and more", None)]),
    ('<figure><img src="a"><figcaption><p>one</p><p>two</p></figcaption></figure>x', [("media", None, "one two"), ("text", "x", None)]),
    ('<figure><figcaption>first</figcaption><img src="a" alt="own"></figure>', [("media", None, "first")]),
    ('<img src="a" alt="own"><figure><img src="b"></figure></figcaption><img src="c" title="t">', [("media", None, "own"), ("media", None, None), ("media", None, "t")]),
    ('<figure><img src="a"><figure><img src="b"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>', [("media", None, "outer"), ("media", None, "inner")]),
    ('<figure><img src="a"><figcaption>one<figure><img src="b"><figcaption>two', [("media", None, "one"), ("media", None, "two")]),
    ("a<br>b<!-- no --><style>no</style> c &lt;d&gt; <", [("text", "a", None), ("text", "b c <d> <", None)]),
    (None, []), ("", []),
])
def test_parsed_html(html, expected):
    items = media_columns.parse_html(html)
    assert [(i["kind"], i["text"], i["caption"]) for i in items] == expected
    assert [i["position"] for i in items] == list(range(len(items)))


def test_long_references_are_whole(spark):
    name = "x" * 3_000_000
    media = spark.createDataFrame([(name, 5)], "digest STRING, size INT")
    pages = spark.createDataFrame([(1, f'<img src="media:{name}">')], "page_id LONG, html STRING")
    assert media_columns.interleaved(media_columns.sequences(pages), media).first()["items"][0]["size"] == 5


def test_media_of_nothing(no_docs):
    assert media_columns.media_columns(no_docs).collect() == []


# --- toxicity ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Nastyword,", "vileword"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id LONG, text STRING"), spark.createDataFrame(labels + labels[:3], "doc_id LONG, quality INT, toxic INT")


def test_toxicity_learns_and_ignores_other_columns(toxic_table):
    docs, labels = toxic_table
    docs = docs.selectExpr("*", "'x' AS lang", "doc_id AS toxic", "text AS _toxic", "doc_id AS _id")
    out = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in out.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in out.values())


def plain_logit(model, text):
    """Word by word and filter by filter."""
    rows = [int(model.rows[zlib.crc32(w.encode()) % toxicity.BUCKETS]) for w in re.findall(r"\w+", (text or "").lower())]
    pooled = []
    for k, (width, w) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(rows)):
                own = rows[at : at + width]
                best = max(best, model.shift[k * toxicity.FILTERS + f] + sum(float(model.embedding[r] @ w[j][:, f]) for j, r in enumerate(own)))
            pooled.append(best)
    return float(np.dot(pooled, model.weights) + model.bias)


def test_scores_equal_the_plain_convolution(docs, rows, toxic_table, monkeypatch):
    model = toxicity.fit(*toxicity.sample(*toxic_table)[:4])
    table = toxic_table[0].limit(12).collect()
    for at_once in (toxicity.AT_ONCE, 7):  # texts together, and texts cut in parts
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        texts = [r["text"] for r in table] + [r[1] for r in rows[:40]]
        got = toxicity.scores(pa.array(texts, pa.string()), model, 0.0)
        lang = toxicity.words_of(pa.array(texts, pa.string()))[2]
        plain = [1 / (1 + np.exp(-np.clip(plain_logit(model, t) - model.thresholds[k], -30, 30))) for t, k in zip(texts, lang, strict=True)]
        assert np.allclose(got, plain, atol=1e-4)


def test_sample_is_bounded_and_whole(spark):
    """Repeats of a document count once, a long text is taken whole, and either kind ends at its words."""
    long = "word " * 50_000
    docs = spark.createDataFrame([(i, long if i == 3 else f"text {i}") for i in range(200)] + [(4, "text 4")] * 300, "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(200)], "doc_id LONG, quality INT, toxic INT")
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    texts, y, _, weights, share = toxicity.sample(docs, labels)
    assert len(texts) == len(learned) and y.sum() == sum(i % 2 == 0 for i in learned) and abs(share - y.mean()) < 1e-9
    assert max(map(len, texts)) == (50_000 if 3 in learned else 2) and np.allclose(weights, 1)
    assert len(toxicity.sample(docs, labels, toxic=9, clean=5)[1]) == 14
    few = toxicity.sample(docs, labels, words=100)
    assert 0 < sum(few[1]) <= 25 and sum(map(len, few[0])) <= 200


def test_scores_do_not_depend_on_the_block(docs, rows, toxic_table):
    model = toxicity.fit(*toxicity.sample(*toxic_table)[:4])
    texts = [r[1] for r in rows]
    first, flat, _ = toxicity.words_of(pa.array(texts, pa.string()))
    together = model.logits(first, flat)
    for i, t in enumerate(texts):
        f, x, _ = toxicity.words_of(pa.array([t], pa.string()))
        assert abs(model.logits(f, x)[0] - together[i]) < 1e-4


def test_toxicity_without_labels(docs, rows, no_labels, no_docs):
    out = toxicity.score(docs, no_labels).collect()
    assert len(out) == len(rows) and {r["score"] for r in out} == {0.0}
    assert toxicity.score(no_docs, no_labels).collect() == []


def test_toxicity_learns_from_every_labelled_document(spark):
    """Words that only the last of 6,000 toxic texts have, in the order of the ids' hash, are learned, and what the
    other label's texts alone have is not held against them."""
    ids = [r["id"] for r in spark.range(12_000).orderBy(F.xxhash64("id"), "id").collect() if zlib.crc32(str(r["id"]).encode()) % 5]
    toxic, clean = ids[:6000], ids[6000:8000]
    rows = [(i, f"{'vileword' if k < 5000 else 'lateword'} plain{k % 7}") for k, i in enumerate(toxic)] + [(i, f"good plain{i % 7}") for i in clean]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, 1, 1) for i in toxic] + [(i, 1, 0) for i in clean], "doc_id LONG, quality INT, toxic INT")
    model, share = toxicity.fitted(docs, labels)
    assert model.rows[zlib.crc32(b"lateword") % toxicity.BUCKETS] > toxicity.RARE and share == 0.75
    got = toxicity.scores(pa.array(["lateword plain1", "vileword plain1", "good plain1"]), model, share)
    assert got[0] >= 0.5 and got[1] >= 0.5 and got[2] < 0.5


def test_toxicity_trainers_do_not_depend_on_the_layout(toxic_table, monkeypatch):
    """Several trainers learn one model, the same one from any partitions and from repeated rows."""
    docs, labels = toxic_table
    monkeypatch.setattr(toxicity, "PER_TRAINER", 200)
    one = toxicity.fitted(docs, labels)[0]
    other = toxicity.fitted(docs.unionByName(docs.filter("doc_id % 3 = 0")).repartition(7, "text"), labels)[0]
    assert np.array_equal(one.embedding, other.embedding) and np.array_equal(one.thresholds, other.thresholds)
    table = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    got = toxicity.scores(pa.array([r["text"] for r in table]), one, 0.0) >= 0.5
    assert np.mean(got == [r["doc_id"] % 4 == 0 for r in table]) > 0.97


def test_toxicity_thresholds_equal_the_plain_search(spark, toxic_table):
    """Over all rows, by language where it has enough of either kind, else the common one."""
    docs, labels = toxic_table
    model = toxicity.fitted(docs, labels)[0]
    rng = random.Random(9)
    texts = [r["text"] + rng.choice([" the of and", " der die und", ""]) * (r["doc_id"] % 3) for r in docs.collect()] + ["le la et des"] * 12
    y = np.array([int(rng.random() < (0.8 if "word," in t or "vile" in t else 0.1)) for t in texts])
    first, flat, lang = toxicity.words_of(pa.array(texts))
    rows = [(bytearray(toxicity.stored(flat[a:b])), int(k), int(t)) for a, b, k, t in zip(first[:-1], first[1:], lang, y, strict=True)]
    got = toxicity.calibrated(spark.createDataFrame(rows, "buckets BINARY, lang INT, toxic INT").repartition(5), model)
    logits, ones = model.logits(first, flat).astype(np.float64), np.ones(len(y))
    overall = toxicity.best_threshold(logits, y, ones, 0.0)
    for k in range(toxicity.LANGUAGES):
        at = lang == k
        enough = min(y[at].sum(), (1 - y[at]).sum()) >= toxicity.CALIBRATES
        assert abs(got[k] - (toxicity.best_threshold(logits[at], y[at], ones[at], overall) if enough else overall)) < 1e-3
    assert len(set(np.round(got, 6))) > 1


def test_toxicity_trains_on_long_texts_in_parts(monkeypatch):
    """The maxima that a step learns from are those of the whole texts."""
    rng = np.random.default_rng(1)
    texts = np.split(rng.permutation(50).astype(np.int32), [1, 31, 33])  # no word twice: no ties
    model = toxicity.untrained(np.arange(50), rng).model
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    ids, starts, lengths = toxicity.spread(first, model.rows[np.concatenate(texts)])
    whole = model.best(ids, starts, lengths)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    parts = model.best(ids, starts, lengths)
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1], atol=1e-6)
    y = np.concatenate(model.windows(ids), axis=1)
    assert np.array_equal(whole[0], [s + y[s : s + n].argmax(axis=0) for s, n in zip(starts, lengths, strict=True)])


def test_likely_rows_have_all_labelled(spark):
    ids = spark.range(20_000).selectExpr("id - 9000 AS doc_id", "'x' AS text")
    known = spark.createDataFrame([(i, 1) for i in range(-9000, 11_000, 20)], "_id LONG, _toxic INT")
    got = {r["doc_id"] for r in toxicity.likely(ids, known, 1000).collect()}
    assert got >= set(range(-9000, 11_000, 20)) and len(got) < 5000
