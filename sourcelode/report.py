"""Reports of an analysis: JSON, terminal text, details, and one page of HTML. Every string is redacted first."""

from __future__ import annotations

import html
import json

from pyspark.sql import functions as F

from .functions.redaction import safe_text
from .plans.scan import Analysis

TABLES = ("files", "dependencies", "findings", "diagnostics", "entry_points", "file_usage", "package_usage", "file_metrics", "functions", "duplicates", "languages", "score_contributions")
TOP, NOTICES, EVIDENCE, SAMPLES = 20, 5, 2, 3


def _plain(value):
    if isinstance(value, str):
        return safe_text(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value if isinstance(value, int | float | bool | type(None)) else float(value)


def _rows(df) -> list[dict]:
    """In the frame's order, one at a time; an absent optional field stays absent."""
    return [_plain(r.asDict(recursive=True)) for r in df.toLocalIterator()]


def to_dict(result: Analysis) -> dict:
    out = {
        "schemaVersion": result.schema_version, "root": safe_text(result.root), "view": {"query": result.view, "totalFindings": result.counters["total_findings"]},
        "limitations": result.limitations, "coverage": {"status": result.status} | {k: v for k, v in result.counters.items() if k != "total_findings"},
        "configuration": {"profile": result.config.profile, "scope": result.config.scope, "limits": result.config.limits, "thresholds": result.config.thresholds, "duplication": result.config.duplication},
        "analysisCoverage": {c: {"status": s, "reason": r} for c, (s, r) in result.category_coverage.items()},
        "score": {"formulaVersion": result.formula_version} | result.score, "ignoreFiles": result.ignore_files,
    }
    return _plain(out) | {t: _rows(result.tables[t]) for t in TABLES if t in result.tables}


def to_json(result: Analysis) -> str:
    return json.dumps(to_dict(result), indent=2, ensure_ascii=False) + "\n"


def score_text(score: dict) -> str:
    if score["status"] == "complete":
        return f"{score['value']:g}/100"
    if score["status"] == "partial":
        return f"{score['observed_value']:g}/100, provisional (partial coverage)"
    return "unavailable (nothing could be assessed)"


def _place(file: str | None, line: int | None) -> str:
    return safe_text(file or "") + (f":{line}" if line is not None else "")


def _proof(e) -> str:
    if e["from_file"] is not None:
        return f"{_place(e['from_file'], e['line'])} -> {safe_text(e['to_file'])}"
    return f"{_place(e['file'], e['line'])}  {safe_text(e['detail'] or '')}"


def to_terminal(result: Analysis, details: bool = False) -> str:
    findings, c = result.tables["findings"], result.counters
    urgent, mild = findings.filter("severity != 'info'"), findings.filter("severity = 'info'")
    lines = [
        f"Repository analysis, schema {result.schema_version}", f"Root: {safe_text(result.root)}",
        f"Scope: {', '.join(map(safe_text, result.config.scope)) or 'repository'}, profile {result.config.profile}",
        f"Coverage: {result.status}, {c['analyzed']} of {c['discovered']} files, {c['skipped']} entries skipped",
        f"Structural score: {score_text(result.score)}",
        f"Query: {result.view}, {findings.count()} of {c['total_findings']} findings",
        "Languages: " + (", ".join(f"{safe_text(r['name'])} {r['analyzed']}/{r['discovered']} [{r['mode']}]" for r in result.tables["languages"].toLocalIterator()) or "none known"),
        "", f"Review first (up to {TOP}):",
    ]
    total = urgent.count()
    for f in urgent.limit(TOP).collect():
        lines += [f"  [{f['severity']}/{f['confidence']}] {f['rule_id']}  {_place(f['file'], f['line'])}  {safe_text(f['title'])}", f"    {safe_text(f['description'])}", f"    {safe_text(f['recommendation'])}"]
        lines.append(f"    Context: {f['context']['role']}, factor {f['context']['factor']:g}")
        lines += [f"    {_proof(e)}" for e in f["evidence"][:EVIDENCE]]
    lines += ["  Nothing in what was assessed; see the coverage before concluding."] * (not total) + [f"  {total - TOP} more in the full report."] * (total > TOP)
    notices = mild.count()
    lines += ["", f"Notices: {notices}"]
    lines += [f"  [info/{f['confidence']}] {f['rule_id']}  {_place(f['file'], f['line'])}" for f in mild.limit(NOTICES).collect()]
    lines += ["", "Coverage by category:"] + [f"  {k}: {s}{'  ' + safe_text(r) if r else ''}" for k, (s, r) in result.category_coverage.items()]
    diagnostics = result.tables["diagnostics"]
    groups = diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"), F.slice(F.sort_array(F.collect_list(F.struct("file", "line"))), F.lit(1), F.lit(SAMPLES)).alias("s"))
    lines += ["", f"Diagnostics: {diagnostics.count()}"]
    for g in groups.orderBy("code").collect():
        lines.append(f"  {g['code']} x {g['n']}  {safe_text(g['message'])}")
        lines += [f"    {_place(s['file'], s['line'])}" for s in g["s"] if s["file"]]
    if details:
        for name in TABLES:
            if name in result.tables:
                lines += ["", f"{name}:"] + ["  " + json.dumps(r, ensure_ascii=False) for r in _rows(result.tables[name])]
    return "\n".join(lines) + "\n"


def to_html(result: Analysis) -> str:
    """No script, no outside resource; the JSON is embedded as inert text."""
    data = to_json(result)
    rows = "".join(
        f"<tr><td>{html.escape(f['severity'])}</td><td>{html.escape(f['rule_id'])}</td><td>{html.escape(_place(f['file'], f['line']))}</td><td>{html.escape(safe_text(f['title']))}</td></tr>"
        for f in result.tables["findings"].toLocalIterator()
    )
    safe = data.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    return (
        "<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\">"
        f"<title>Repository analysis</title><style>body{{font-family:sans-serif;margin:2rem}}td{{padding:.2rem .6rem}}</style></head><body><h1>{html.escape(score_text(result.score))}</h1>"
        f"<table>{rows}</table><pre>{html.escape(to_terminal(result))}</pre><script type=\"application/json\">{safe}</script></body></html>\n"
    )
