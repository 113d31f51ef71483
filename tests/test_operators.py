"""Operators against plain Python, and the catalogue against DuckDB."""

import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sourcelode.functions import text as fn
from sourcelode.operators import budgets, coverage, duplication, filters, graph, joins, rules, score
from sourcelode.operators.common import running_total
from sourcelode.plans import catalogue
from sourcelode.streaming import inventory

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, bool | str):
        return x
    return round(float(x), 6)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the synthetic tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SMALL)
    expected = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(map(value, r)) for r in expected.fetchall())


def test_parsing_leaves_no_source_out(spark, tmp_path):
    """Sources of more tokens than the limit of a scan."""
    turns = [(1, 0, "user", "x\n" * 60_000), (1, 1, "assistant", "short")]
    spark.createDataFrame(turns, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    pages = [(1, "u", '<a href="/p">p</a> ' * 70_000), (2, "u", '<a href="/q">q</a>')]
    spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, n in (("parsed_functions", 2), ("parsed_references", 70_001)):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        expected = con.execute(catalogue.ORACLES[name])
        names = [d[0] for d in expected.description]
        got = Counter(tuple(value(r[c]) for c in names) for r in df.collect())
        assert got.total() == n and got == Counter(tuple(map(value, r)) for r in expected.fetchall())


def test_entry_file():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "exact_text_duplicates" in entry.queries()


# --- scores ------------------------------------------------------------------------------------------------


def brute_allocation(rows, caps, total=100):
    used, spent, out = defaultdict(int), 0, {}
    for category, key, raw in sorted(rows):
        own = max(0, min(raw, caps[category] * 10**6 - used[category], total * 10**6 - spent))
        used[category] += own
        spent += own
        out[category, key] = own
    return out


@pytest.mark.parametrize("keyed", [True, False])
def test_allocation(spark, keyed):
    rng = random.Random(keyed)
    caps = {"a": 30, "b": 50, "c": 45}
    rows = [(rng.choice("abc"), f"k{i:03}", rng.randint(0, 6_000_000)) for i in range(80)]
    df = spark.createDataFrame([(1, c, k, r / 1e6) for c, k, r in rows], "g INT, category STRING, key STRING, raw_penalty DOUBLE")
    out = score.allocate(df, caps, keys=["g"] if keyed else [])
    assert {(r["category"], r["key"]): int(r["applied_penalty"] * 10**6) for r in out.collect()} == brute_allocation(rows, caps)


def test_contributions_keep_one_identity(spark):
    schema = "rule_id STRING, category STRING, subject STRING, file STRING, confidence STRING, related_files ARRAY<STRING>, context_factor DOUBLE"
    rows = [
        ("oversized-file", "size", "f", "f", "CONFIRMED", [], 0.5), ("oversized-function", "size", "g:1:1", "f", "CONFIRMED", [], 1.0),
        ("runtime-cycle", "dependencies", None, "a", "CONFIRMED", ["b", "a"], None), ("runtime-cycle", "dependencies", None, "b", "CONFIRMED", ["a", "b"], None),
        ("duplicate-block", "duplication", 'q"x', "f", "LIKELY", ["f"], 0.5),
    ]
    out = {r["key"]: float(r["raw_penalty"]) for r in score.contributions(spark.createDataFrame(rows, schema)).collect()}
    assert out == {'["size","f"]': 2.0, '["cycles",["a","b"]]': 8.0, '["duplication","f","q\\"x"]': 1.875}


@pytest.mark.parametrize(("states", "files", "expected"), [(["complete"] * 5, 1, ("complete", 98.5, 98.5)), (["complete"] * 4 + ["partial"], 1, ("partial", None, 98.5)), (["unavailable"] * 5, 1, ("unavailable", None, None)), (["complete"] * 5, 0, ("unavailable", None, None))])
def test_final_score(spark, states, files, expected):
    spent = spark.createDataFrame([("size", 1.5)], "category STRING, p DOUBLE").select("category", F.col("p").cast("decimal(18,6)").alias("applied_penalty"))
    assert tuple(score.final_score(spent, spark.createDataFrame([(str(i), s) for i, s in enumerate(states)], "category STRING, status STRING"), files).first()) == expected


def test_running_total_over_many_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), i, rng.randint(0, 9)) for i in range(500)]
    out = running_total(spark.createDataFrame(rows, "k STRING, i INT, v INT"), "v", ["i"], "t", ["k"])
    sums, expected = defaultdict(int), {}
    for k, i, v in rows:
        sums[k] += v
        expected[i] = sums[k]
    assert {r["i"]: r["t"] for r in out.collect()} == expected


def test_skipping_budget(spark):
    rows = [("r", i, b) for i, b in enumerate([4, 9, 3, 2, 1])]
    out = budgets.skipping_budget(spark.createDataFrame(rows, "k STRING, i INT, v INT"), "k", "v", ["i"], 8)
    assert [r["within"] for r in sorted(out.collect(), key=lambda r: r["i"])] == [True, False, True, False, True]


# --- graphs ------------------------------------------------------------------------------------------------


def test_ring_of_20000(spark):
    n = 20_000
    edges = spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("n%05d", "id").alias("from_file"), F.format_string("n%05d", (F.col("id") + 1) % n).alias("to_file"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    found = graph.strong_components(edges).select("start", "size", F.size("path").alias("steps")).collect()
    assert [tuple(r) for r in found] == [("n00000", n, n)]


def test_components_and_paths(spark):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randint(0, 25):02}", f"n{rng.randint(0, 25):02}") for _ in range(40)})
    df = spark.createDataFrame([("r", a, b, i % 3, 1) for i, (a, b) in enumerate(edges)], "repo_id STRING, from_file STRING, to_file STRING, line INT, column INT")
    reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    for _ in range(26):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    expected = {frozenset(b for b in reach if b in reach[a] and a in reach[b]) for a in reach if a in reach[a]}
    found = graph.strong_components(df).collect()
    assert {frozenset(r["members"]) for r in found} == expected
    for r in found:
        steps = [(e["from_file"], e["to_file"]) for e in r["path"]]
        assert steps[0][0] == steps[-1][1] == r["start"] == min(r["members"]) and set(steps) <= set(edges)
        assert all(a[1] == b[0] for a, b in zip(steps, steps[1:], strict=False))
    seeds = spark.createDataFrame([(edges[0][0],)], "node STRING")
    assert {r["node"] for r in graph.reachable(df, seeds).collect()} == reach[edges[0][0]] | {edges[0][0]}
    capped = graph.capped_components(graph.strong_components(df), 1).collect()
    assert len(capped) == 1 and capped[0]["truncated"] == (len(expected) > 1)


# --- duplicates, joins, filters ----------------------------------------------------------------------------


def test_nested_groups_equal_the_greedy_order(spark):
    rng = random.Random(9)
    for _ in range(3):
        occurrences, spans = [], set()
        for g in range(14):
            length = rng.randint(1, 8)
            for _ in range(rng.randint(2, 3)):
                f, s = rng.choice("ab"), rng.randint(0, 12)
                if (f, s, s + length) not in spans:
                    spans.add((f, s, s + length))
                    occurrences.append((length, f"h{g}", f, s, s + length))
        kept, chosen = set(), defaultdict(list)
        groups = defaultdict(list)
        for o in occurrences:
            groups[o[0], o[1]].append(o)
        for key in sorted(groups, key=lambda k: -k[0]):
            if all(any(a <= s and b >= e for a, b in chosen[f]) for _, _, f, s, e in groups[key]):
                continue
            kept.add(key)
            for _, _, f, s, e in groups[key]:
                chosen[f].append((s, e))
        df = spark.createDataFrame(occurrences, "length INT, hash STRING, file STRING, start INT, end INT")
        assert {(r["length"], r["hash"]) for r in duplication.without_nested(df).collect()} == kept


def test_ignored_paths(spark):
    paths = spark.createDataFrame([("a/b/c.ts",), ("a/keep.ts",), ("x.ts",)], "path STRING")
    rows = [("", 0, 0, "^a/b/$", False), ("a", 0, 0, "^b/c[.]ts$", True), ("", 0, 1, "^x[.]ts$", False), ("", 1, 0, "^x[.]ts$", True)]
    out = filters.ignored_paths(paths, spark.createDataFrame(rows, "directory STRING, file_rank INT, rule_no INT, regex STRING, negated BOOLEAN"))
    assert {r["path"]: r["ignored"] for r in out.collect()} == {"a/b/c.ts": True, "a/keep.ts": False, "x.ts": False}


def test_glob_join(spark):
    files = spark.createDataFrame([("src/a.ts",), ("b.ts",)], "path STRING")
    assert {tuple(r) for r in joins.glob_join(["src/*.ts", "**/*.ts"], files).collect()} == {("src/*.ts", "src/a.ts"), ("**/*.ts", "src/a.ts"), ("**/*.ts", "b.ts")}
    assert joins.glob_join([], files).count() == 0


@pytest.mark.parametrize(("role", "lines", "factor", "severity"), [("application", 300, 1.0, "warning"), ("application", 110, 0.1, "info"), ("test", 200, 0.25, "info"), ("test", 400, 0.25, "warning"), ("migration", 900, 0.0, "info"), ("tooling", 150, 0.25, "info")])
def test_size_context(spark, role, lines, factor, severity):
    r = rules.size_context(spark.createDataFrame([(lines, role)], "lines INT, role STRING"), F.lit(100)).first()
    assert (r["factor"], r["severity"]) == (factor, severity)


def test_coverage_machine():
    facts = {"syntax_files": 1, "text_files": 0, "entries": 1, "manifests": 1, "early_diagnostics": False, "any_diagnostics": False, "uncertain": False, "unknown_packages": False, "duplication_complete": True, "components_truncated": False, "aborted": False}
    states = lambda **more: {c: s for c, (s, _) in coverage.categories(**facts | more).items()}
    assert set(states().values()) == {"complete"} and states(entries=0)["unusedFiles"] == "unavailable" and states(manifests=0)["packages"] == "unavailable"
    assert states(uncertain=True)["unusedFiles"] == "partial" and set(states(any_diagnostics=True).values()) == {"partial"}
    assert states(text_files=1, entries=0)["unusedFiles"] == "partial" and states(text_files=1, syntax_files=0)["cycles"] == "unavailable"
    assert set(states(aborted=True).values()) == {"unavailable"}


def test_path_functions(spark):
    rows = [("src/a/b.ts", "../c.js"), ("a.ts", "./x"), ("a.ts", "../out"), ("d/e.ts", ".")]
    out = spark.createDataFrame(rows, "f STRING, s STRING").select(fn.resolved_path(F.col("f"), F.col("s")).alias("p")).collect()
    assert [r["p"] for r in out] == ["src/c.js", "x", None, "d"]
    names = spark.createDataFrame([("a.TS",), (".ts",), ("x/BUILD",), ("q.unknown",), ("b.tar.py",)], "p STRING").select(fn.language(F.col("p")).alias("l")).collect()
    assert [r["l"] for r in names] == ["TypeScript", None, "Bazel", None, "Python"]


# --- texts -------------------------------------------------------------------------------------------------


def test_occurrences_are_verified_by_text(spark, monkeypatch):
    """Where every digest collides, the texts tell."""
    files = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "file STRING, text STRING")
    for name in ("md5", "xxhash64"):
        monkeypatch.setattr(duplication.F, name, lambda *columns: F.lit(0))
    monkeypatch.setattr(duplication.fn, "fingerprint", lambda text: F.lit("same"))
    candidates = duplication.text_candidates(files, 1, 1)
    found = duplication.verified_occurrences(files, candidates, duplication.text_groups(candidates)).collect()
    assert sorted((r["group_file"], r["file"]) for r in found) == [("a", "a"), ("a", "c")]


# --- streams -----------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = [("r", f"f{i}.py", "same\ntext" if i % 2 else f"text {i}", 9, f"2024-01-01 00:{i:02}:00") for i in range(10)]
    df = spark.createDataFrame(rows, "repo_id STRING, path STRING, content STRING, bytes LONG, seen STRING").withColumn("seen", F.to_timestamp("seen"))
    df.write.parquet(str(tmp_path / "in"))
    got = {}
    for name, stream, mode in (("w", inventory.language_windows, "complete"), ("d", inventory.duplicate_counts, "complete"), ("f", inventory.first_copies, "append")):
        q = stream(inventory.snapshots(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = spark.table(name).collect()
    assert [(r["language"], r["files"], r["lines"]) for r in got["w"]] == [("Python", 10, 15)]
    assert [(r["n"], r["first_path"]) for r in got["d"]] == [(5, "f1.py")] and len(got["f"]) == 6


def test_identities_are_json_text(spark):
    import json

    rows = [("cycles", "runtime-cycle", "f", None, ['b"', "a\\\n"]), ("size", "oversized-file", "f\t", "s", []), ("packages", "p", "f", None, []), ("packages", "p", "f", "\u0001\"", [])]
    table = spark.createDataFrame(rows, "category STRING, rule STRING, file STRING, subject STRING, related ARRAY<STRING>")
    keys = [json.loads(r["k"]) for r in table.select(score.identity_key(*[F.col(c) for c in table.columns]).alias("k")).collect()]
    assert keys == [["cycles", ["a\\\n", 'b"']], ["size", "f\t"], ["packages", "f", None], ["packages", "f", '\u0001"']]
