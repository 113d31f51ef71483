"""Whole scans of small trees."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from sourcelode import report
from sourcelode.cli import main
from sourcelode.model import Configuration, InputError
from sourcelode.operators import filters, graph
from sourcelode.plans.scan import configuration_table, exit_code, explode, parse_files, parse_one, resolve_references, scan, within_budgets
from sourcelode.sources import manifest, parse_ts
from sourcelode.sources.tsconfig import TSConfig


def make(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def cycle(spark, tmp_path_factory):
    root = make(tmp_path_factory.mktemp("cycle"), {"index.ts": "import { w } from './worker.js';\nexport const i = w;\n", "worker.ts": "import { i } from './index';\nexport const w = i;\n", "package.json": "{}"})
    return root, scan(spark, root)


def test_cycle(cycle):
    _, result = cycle
    found = result.tables["findings"].collect()
    assert [(f["rule_id"], f["file"], f["related_files"]) for f in found] == [("runtime-cycle", "index.ts", ["index.ts", "worker.ts"])]
    assert [(e["from_file"], e["to_file"]) for e in found[0]["evidence"]] == [("index.ts", "worker.ts"), ("worker.ts", "index.ts")]
    assert result.score == {"status": "complete", "value": 92.0, "observed_value": 92.0} and result.tables["dependencies"].count() == 2
    assert result.status == "complete" and exit_code(result) == 1 and exit_code(result.select("duplicates")) == 0


def test_reports(cycle):
    _, result = cycle
    data = json.loads(report.to_json(result))
    assert data["score"]["value"] == 92 and len(data["findings"]) == 1 and data["view"] == {"query": "scan", "totalFindings": 1}
    text, page = report.to_terminal(result), report.to_html(result)
    assert "92/100" in text and "runtime-cycle" in text and "<script type=\"application/json\">" in page and "default-src 'none'" in page


def test_usage_packages_sizes_and_duplicates(spark, tmp_path):
    body = "{\n" + "".join(f"  const a{i} = call({i}, 'x') + {i};\n" for i in range(8)) + "}\n"
    root = make(tmp_path, {
        "package.json": json.dumps({"main": "src/main.js", "dependencies": {"used": "1", "unused": "1", "fs": "1"}, "devDependencies": {"runner": "1", "@types/x": "1"}, "peerDependencies": {"peer": "1"}, "scripts": {"test": "runner src/a.test.ts"}}),
        "src/main.ts": "import 'used/sub';\nimport type { T } from './typed';\nimport fs from 'node:fs';\n", "src/typed.ts": "export type T = 1;\n", "src/orphan.ts": f"export function one() {body}",
        "src/a.test.ts": f"function two() {body}", "long.config.ts": "".join("x();\n" for _ in range(700)), ".sourcelode.yml": "thresholds: {fileLines: 300}\nentryPoints: [long.config.ts]\n",
    })
    result = scan(spark, root)
    usage = {r["file"]: r["state"] for r in result.tables["file_usage"].collect()}
    assert usage == {"src/main.ts": "reachable", "src/typed.ts": "reachable", "src/orphan.ts": "candidate", "src/a.test.ts": "reachable", "long.config.ts": "reachable"}
    assert {r["name"]: r["state"] for r in result.tables["package_usage"].collect()} == {"used": "used", "unused": "candidate", "fs": "candidate", "runner": "used", "@types/x": "indirect", "peer": "indirect"}
    found = {(f["rule_id"], f["file"]): f for f in result.tables["findings"].collect()}
    assert set(found) == {("potentially-unused-file", "src/orphan.ts"), ("potentially-unused-package", "package.json"), ("oversized-file", "long.config.ts"), ("duplicate-block", "src/a.test.ts")}
    assert found["duplicate-block", "src/a.test.ts"]["related_files"] == ["src/a.test.ts", "src/orphan.ts"] and found["oversized-file", "long.config.ts"]["context"]["factor"] == 1.0
    assert result.status == "complete"


def test_partial_coverage(spark, tmp_path):
    root = make(tmp_path, {"bad.ts": "export const = ;", "a.ts": "import './missing';\nimport '../../outside';\nimport(variable);\nimport '@lib/tool';\n", "lib/tool.ts": "", "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}', "a.py": "x = 1\n" * 30, "b.py": "x = 1\n" * 30})
    result = scan(spark, root)
    codes = {r["code"] for r in result.tables["diagnostics"].collect()}
    assert codes == {"SYNTAX_ERROR", "UNRESOLVED_REFERENCE", "ROOT_ESCAPE", "INDETERMINATE_REFERENCE"} and exit_code(result) == 2
    edges = {r["specifier"]: (r["resolution"], r["to_file"]) for r in result.tables["dependencies"].collect()}
    assert edges["@lib/tool"] == ("internal", "lib/tool.ts") and edges["./missing"][0] == "unresolved" and edges[None][0] == "indeterminate"
    assert [(f["rule_id"], f["file"]) for f in result.tables["findings"].collect()] == [("duplicate-block", "a.py")]
    assert result.score["status"] == "partial" and result.score["value"] is None and result.score["observed_value"] == 95.0


def chain(n):
    return {f"f{i}.ts": f"import './f{i + 1}';\nexport function a{i}() {{ return {i}; }}\n" for i in range(n)} | {f"f{n}.ts": "export const end = 1;\n"}


def limited(spark, tmp_path, files, **limits):
    lines = "".join(f"  {k}: {v}\n" for k, v in limits.items())
    return scan(spark, make(tmp_path, files | {".sourcelode.yml": f"limits:\n{lines}"}))


def codes(result):
    return sorted((r["code"], r["file"]) for r in result.tables["diagnostics"].collect())


def test_references_that_do_not_fit_are_left_out(spark, tmp_path):
    files = {"a.ts": "import './c';\n", "b.ts": "import './a';\nimport './c';\nimport './d';\n", "c.ts": "import './a';\n", "d.ts": "export const x = 1;\n"}
    result = limited(spark, tmp_path, files, maxDependencies=3)
    assert codes(result) == [("DEPENDENCY_LIMIT", "b.ts")] and result.status == "partial"
    assert [r["path"] for r in result.tables["files"].collect()] == ["a.ts", "c.ts", "d.ts"]
    assert [f["file"] for f in result.tables["findings"].collect() if f["rule_id"] == "runtime-cycle"] == ["a.ts"]


def test_a_full_budget_of_references_ends_the_scan(spark, tmp_path):
    result = limited(spark, tmp_path, chain(4), maxDependencies=2)
    assert ("DEPENDENCY_LIMIT", None) in codes(result) and result.tables["findings"].count() == 0 and result.status == "partial"


def test_functions_and_tokens_beyond_the_limits(spark, tmp_path):
    result = limited(spark, tmp_path, chain(3), maxDuplicationTokens=20)
    assert [c for c, _ in codes(result)] == ["DUPLICATION_TOKEN_LIMIT"] * 3 and result.category_coverage["duplication"][0] == "partial"
    many = {"a.ts": "".join(f"function f{i}() {{}}\n" for i in range(7)), "b.ts": "function g() {}\n"}
    result = limited(spark, tmp_path / "m", many, maxEntries=5)
    assert codes(result) == [("METRIC_LIMIT", "a.ts"), ("METRIC_LIMIT", "b.ts")]
    assert sorted(r["name"] for r in result.tables["functions"].collect()) == [f"f{i}" for i in range(5)]


def test_bytes_read_before_the_limit_are_kept(spark, tmp_path):
    result = limited(spark, tmp_path, {"a.ts": "x();\n", "b.ts": "y();\n" * 100, "c.ts": "z();\n"}, maxTotalBytes=200)
    assert codes(result) == [("TOTAL_BYTES_LIMIT", "b.ts")] and [r["path"] for r in result.tables["files"].collect()] == ["a.ts"]
    assert result.status == "partial"


def test_generated_sources_are_skipped(spark, tmp_path):
    files = {"a.ts": "// Code generated by protoc. DO NOT EDIT.\nimport './b';\n", "b.ts": "import './a';\n", "c.py": "# auto-generated\n", "d.ts": "/* @generated */ export {};\n"}
    result = scan(spark, make(tmp_path, files))
    assert [r["path"] for r in result.tables["files"].collect()] == ["b.ts"] and result.counters["skipped"] == 3
    assert result.counters["discovered"] == 4 and not result.tables["findings"].filter("rule_id = 'runtime-cycle'").count()


def test_text_files_are_unknown(spark, tmp_path):
    result = scan(spark, make(tmp_path, {"index.ts": "export {};\n", "a.py": "x = 1\n"}))
    usage = {r["file"]: (r["state"], r["confidence"]) for r in result.tables["file_usage"].collect()}
    assert usage == {"index.ts": ("reachable", "CONFIRMED"), "a.py": ("unknown", "UNKNOWN")}
    assert any("Other languages" in x for x in result.limitations)


def test_deadline_and_cancellation(spark, tmp_path):
    root = make(tmp_path, chain(3))
    result = scan(spark, root, deadline_ms=1)
    assert {c for c, _ in codes(result)} == {"SCAN_TIMEOUT"} and result.status == "partial" and result.tables["findings"].count() == 0
    stop = threading.Event()
    stop.set()
    result = scan(spark, root, cancelled=stop)
    assert [c for c, _ in codes(result)] == ["CANCELLED"] and exit_code(result) == 2
    assert scan(spark, root).status == "complete"


def test_repositories_with_equal_paths_do_not_mix(spark):
    """Two trees in one table of files: references, cycles, budgets and manifests stay within each."""
    rows = [
        ("one", "a.ts", "import './b';\nimport '@x/lib';\n"), ("one", "b.ts", "import './a';\n"), ("one", "lib.ts", ""),
        ("two", "a.ts", "import './b';\nimport '@x/lib';\n"), ("two", "lib/index.ts", ""), ("two", "z.ts", "import './a';\nimport './lib';\nimport './lib';\n"),
    ]
    files = spark.createDataFrame([(r, p, c, len(c)) for r, p, c in rows], "repo_id STRING, path STRING, content STRING, bytes LONG")
    limits = Configuration().limits | {"maxDependencies": 4}
    parsed, ended = within_budgets(parse_files(files, limits), limits)
    assert not ended and [(r["repo_id"], r["file"]) for r in parsed.filter("NOT valid").collect()] == [("two", "z.ts")]
    configs = configuration_table(spark, {r: [TSConfig("", aliases=[("@x/*", ["*"], ["*"])])] for r in ("one", "two")})
    edges = resolve_references(explode(parsed, "dependencies"), parsed.filter("valid").select("repo_id", F.col("file").alias("path")), configs)
    found = {(r["repo_id"], r["from_file"], r["specifier"]): r["to_file"] for r in edges.collect()}
    assert found == {
        ("one", "a.ts", "./b"): "b.ts", ("one", "a.ts", "@x/lib"): "lib.ts", ("one", "b.ts", "./a"): "a.ts",
        ("two", "a.ts", "./b"): None, ("two", "a.ts", "@x/lib"): "lib/index.ts",
    }
    cycles = graph.strong_components(filters.runtime_edges(edges)).collect()
    assert [(c["repo_id"], c["members"]) for c in cycles] == [("one", ["a.ts", "b.ts"])]
    packages = spark.createDataFrame([(r, "package.json", json.dumps({"dependencies": {n: "1"}})) for r, n in (("one", "p"), ("two", "q"))], "repo_id STRING, path STRING, content STRING")
    assert sorted((r["repo_id"], r["packages"][0]["name"]) for r in manifest.manifest_facts(packages).collect()) == [("one", "p"), ("two", "q")]


def test_a_slow_file_costs_its_own_rows(monkeypatch):
    def slow(path, content, limits):
        while content == "slow":
            pass
        return parse_ts.Parsed(lines=1)

    monkeypatch.setattr(parse_ts, "parse", slow)
    began = time.monotonic()
    late, other = parse_one("a.ts", "slow", {"maxParseTimeMs": 200}), parse_one("b.ts", "fast", {"maxParseTimeMs": 200})
    assert time.monotonic() - began < 5 and not late.valid and late.diagnostics[0]["code"] == "PARSE_TIMEOUT" and other.valid


def test_command_line(spark, tmp_path, capsys):
    root = make(tmp_path, {".sourcelode.yml": "nonsense: 1", "a.ts": ""})
    assert main(["scan", root], spark) == 2 and "INVALID_CONFIG" in capsys.readouterr().err
    assert main(["scan", "--unknown"], spark) == 2
    with pytest.raises(InputError):
        scan(spark, str(tmp_path / "nowhere"))
