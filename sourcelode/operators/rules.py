"""Rules: what makes a finding, its context, its place in the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..model import WEIGHTS

# Roles, their weights, and the paths that show them.
ROLES = ("application", "unknown", "tooling", "test", "migration")
ROLE_FACTORS = {"migration": 0.0, "test": 0.25, "tooling": 0.5, "application": 1.0, "unknown": 1.0}
TEST_PATH = r"(?:^|/)(?:test|tests|__tests__|e2e)/|\.(?:test|spec)\.[^/]+$|(?:^|/)scripts/(?:test|check)[-_][^/]+\.[^/]+$"
MIGRATION_PATH = r"(?i)(?:^|/)(?:migrations|db/migration)/.*\.sql$"
APPLICATION_PATH = r"(?:^|/)(?:src|app|lib|components|services)/"
TOOL_CONFIG = r"\.config\.[cm]?[jt]s$"
EVIDENCE = "array<struct<from_file:string,to_file:string,file:string,line:int,column:int,end_line:int,detail:string>>"
REASONS = {
    "application": "Application code, or code that a runtime entry point reaches; test conventions lower nothing here.",
    "test": "A test by convention that the application does not reach at runtime; long scenarios need not mean too many duties.",
    "migration": "SQL among migrations: order and atomicity can justify length, and applied ones stay as they are.",
    "tooling": "An entry point of a script or tool: still worth a review, at less weight.",
    "unknown": "Nothing tells the role, and a lack of references earns no exception.",
}


def evidence(file: Column, detail: Column, line=None, column=None, end_line=None) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            null("string").alias("from_file"), null("string").alias("to_file"), file.alias("file"),
            (line if line is not None else null("int")).cast("int").alias("line"),
            (column if column is not None else null("int")).cast("int").alias("column"),
            (end_line if end_line is not None else null("int")).cast("int").alias("end_line"), detail.alias("detail"),
        )
    )


def finding(rows: DataFrame, *extra: str, rule: str, category: str, subject: Column, title: str, description: Column, confidence: Column, file: Column, recommendation: str, proof: Column, line: Column | None = None, related: Column | None = None) -> DataFrame:
    return rows.select(
        *extra, F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), subject.alias("subject"), F.lit(title).alias("title"),
        description.alias("description"), F.lit("warning").alias("severity"), confidence.alias("confidence"), file.alias("file"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        (related if related is not None else F.array().cast("array<string>")).alias("related_files"),
        proof.cast(EVIDENCE).alias("evidence"), F.lit(recommendation).alias("recommendation"),
    )


def oversized_files(metrics: DataFrame, limit: int) -> DataFrame:
    """metrics(file, lines): more lines than the limit."""
    big = metrics.filter(F.col("lines") > limit).withColumn("observed", F.col("lines"))
    text = F.format_string(f"%d physical lines; the limit is {limit}.", "lines")
    return finding(
        big, "observed", rule="oversized-file", category="size", subject=F.col("file"), title="File above the line limit", description=text,
        confidence=F.lit("CONFIRMED"), file=F.col("file"), line=F.lit(1),
        proof=evidence(F.col("file"), F.lit("Blank lines and comments count; the empty end after a last line break does not."), F.lit(1), None, F.col("lines")),
        recommendation="See what belongs together, and split only what has a purpose of its own.",
    )


def oversized_functions(functions: DataFrame, limit: int) -> DataFrame:
    """functions(file, name, line, column, end_line, lines): more lines than the limit."""
    big = functions.filter(F.col("lines") > limit).withColumn("observed", F.col("lines"))
    text = F.format_string(f"%s: %d lines from signature to end; the limit is {limit}.", "name", "lines")
    return finding(
        big, "observed", rule="oversized-function", category="size", subject=F.concat_ws(":", "name", F.col("line").cast("string"), F.col("column").cast("string")),
        title="Function above the line limit", description=text, confidence=F.lit("CONFIRMED"), file=F.col("file"), line=F.col("line"),
        proof=evidence(F.col("file"), F.lit("First to last line of a function with a body."), F.col("line"), F.col("column"), F.col("end_line")),
        recommendation="Look at its duties before taking parts out; do not cut it only for the count.",
    )


def unused_files(usage: DataFrame, entry_count: int) -> DataFrame:
    own = usage.filter("state = 'candidate'")
    return finding(
        own, rule="potentially-unused-file", category="unused", subject=F.col("file"), title="File that may be unused",
        description=F.concat("reason", F.lit(" Other use remains possible.")), confidence=F.col("confidence"), file=F.col("file"),
        proof=evidence(F.col("file"), F.lit(f"{entry_count} entry points were considered; no path is no proof.")),
        recommendation="Look for outside consumers, conventions and dynamic loading before removing it.",
    )


def package_usage(declared: DataFrame, proof: DataFrame, uncertain: bool) -> DataFrame:
    """declared(name, manifest, sections), proof(name, manifest, kind) -> with state and confidence."""
    sums = proof.groupBy("name", "manifest").agg(F.bool_or(F.col("kind").isin("runtime", "type-only", "script")).alias("_used"))
    rows = declared.join(sums, ["name", "manifest"], "left")
    types = F.col("name").startswith("@types/")
    optional = F.array_contains("sections", "peerDependencies") | F.array_contains("sections", "optionalDependencies") | types
    state = (
        F.when(F.col("_used"), "used").when(F.col("_used").isNotNull(), "unknown").when(optional, "indirect")
        .when(F.lit(uncertain), "unknown").otherwise("candidate")
    )
    rows = rows.withColumn("state", state).drop("_used")
    confidence = F.when(F.col("state") == "used", "CONFIRMED").when((F.col("state") == "indirect") & types, "LIKELY").when(F.col("state") == "candidate", "SUSPICIOUS").otherwise("UNKNOWN")
    return rows.withColumn("confidence", confidence)


def unused_packages(usage: DataFrame) -> DataFrame:
    own = usage.filter("state = 'candidate'")
    text = F.concat(F.lit("No static reference or known script tool; declared in "), F.array_join("sections", ", "), F.lit(". Other use remains possible."))
    return finding(
        own, rule="potentially-unused-package", category="packages", subject=F.col("name"), title="Dependency that may be unused",
        description=F.concat_ws(": ", "name", text), confidence=F.lit("SUSPICIOUS"), file=F.col("manifest"), proof=evidence(F.col("manifest"), text),
        recommendation="Look at plugins, configuration, outside consumers and tools before removing it.",
    )


def cycle_findings(components: DataFrame) -> DataFrame:
    """components(start, members, path) of strong_components."""
    null = lambda kind: F.lit(None).cast(kind)
    steps = F.transform(
        "path",
        lambda e: F.struct(e["from_file"].alias("from_file"), e["to_file"].alias("to_file"), null("string").alias("file"), e["line"].alias("line"), e["column"].alias("column"), null("int").alias("end_line"), null("string").alias("detail")),
    )
    return finding(
        components, rule="runtime-cycle", category="dependencies", subject=null("string"), title="Cycle of runtime dependencies",
        description=F.lit("Static runtime references close a path; that each branch runs is not shown."), confidence=F.lit("CONFIRMED"),
        file=F.col("start"), line=F.get("path", F.lit(0))["line"], related=F.col("members"), proof=steps,
        recommendation="Review the coupling; shared duties can move to a module of their own.",
    )


def duplicate_findings(groups: DataFrame, title: str, detail: str) -> DataFrame:
    """groups(id, file, line, related_files, blocks)."""
    null = F.lit(None).cast("string")
    proof = F.transform(
        "blocks",
        lambda b: F.struct(null.alias("from_file"), null.alias("to_file"), b["file"].alias("file"), b["line"].cast("int").alias("line"), b["column"].cast("int").alias("column"), b["end_line"].cast("int").alias("end_line"), F.lit(detail).alias("detail")),
    )
    return finding(
        groups, rule="duplicate-block", category="duplication", subject=F.col("id"), title=title,
        description=F.format_string("%d occurrences, equal throughout.", F.size("blocks")), confidence=F.lit("CONFIRMED"), file=F.col("file"),
        line=F.col("line"), related=F.col("related_files"), proof=proof,
        recommendation="Compare purpose and context before sharing code; equal text can have good reasons.",
    )


def role(path: Column, reached: Column, is_test: Column, is_migration: Column, is_tool: Column, application: str = APPLICATION_PATH) -> Column:
    return (
        F.when(reached, "application").when(is_test, "test").when(is_migration, "migration").when(is_tool, "tooling")
        .when(path.rlike(application), "application").otherwise("unknown")
    )


def strongest_role(own: Column, others: Column) -> Column:
    """Of a finding's files: application before unknown, tooling and test; else the finding's own."""
    out = own
    for r in ("test", "tooling", "unknown", "application"):
        out = F.when((own == r) | F.array_contains(others, r), r).otherwise(out)
    return out


def role_factor(role_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_FACTORS.items() for x in pair]), role_)


def size_context(rows: DataFrame, limit: Column) -> DataFrame:
    """rows(lines, role) -> with factor and severity; unknown lines count as twice the limit."""
    lines, weight = F.coalesce(F.col("lines"), limit * 2), role_factor(F.col("role"))
    excess = fn.size_excess(lines, limit)
    mild = (F.col("role") == "migration") | (excess <= 0.2) | ((weight < 1) & F.col("lines").isNotNull() & (lines < limit * 4))
    return rows.withColumn("factor", fn.size_factor(lines, limit, weight)).withColumn("severity", F.when(mild, "info").otherwise("warning"))


def contextualized(findings: DataFrame, roles: DataFrame, sizes: DataFrame, file_lines: int, function_lines: int) -> DataFrame:
    """findings, roles(file, role), sizes(rule_id, file, line, column, lines) -> with context and severity.

    Related files meet their roles exploded, and come back as the set of roles (at most five) of a finding.
    """
    keyed = findings.withColumn("_id", F.xxhash64("rule_id", "file", "subject", F.array_join("related_files", "\n"), "line"))
    related = keyed.select("_id", F.explode("related_files").alias("file")).join(roles, "file").groupBy("_id").agg(F.collect_set("role").alias("_roles"))
    rows = keyed.join(roles, "file", "left").join(related, "_id", "left")
    own = F.coalesce("role", F.lit("unknown"))
    rows = rows.withColumn("role", strongest_role(own, F.coalesce("_roles", F.array().cast("array<string>"))))
    first = F.get("evidence", F.lit(0))
    rows = rows.withColumn("_line", F.when(F.col("rule_id") == "oversized-function", F.col("line"))).withColumn("_column", F.when(F.col("rule_id") == "oversized-function", first["column"]))
    s = sizes.select(F.col("rule_id").alias("_r"), F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("column").alias("_c"), "lines")
    same = (F.col("rule_id") == F.col("_r")) & (F.col("file") == F.col("_f"))
    same = same & F.col("_line").eqNullSafe(F.col("_l")) & F.col("_column").eqNullSafe(F.col("_c"))
    rows = rows.join(s, same, "left")
    limit = F.when(F.col("rule_id") == "oversized-file", file_lines).otherwise(function_lines)
    sized = size_context(rows.withColumnRenamed("severity", "_severity"), limit)
    is_size, is_dup = F.col("category") == "size", (F.col("rule_id") == "duplicate-block") & (F.col("role") == "test")
    is_tool = (F.col("rule_id") == "potentially-unused-file") & (F.col("role") == "tooling")
    factor = F.when(is_size, F.col("factor")).when(is_dup | is_tool, 0.5).otherwise(1.0)
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("role"))
    kept = [c for c in findings.columns if c not in ("severity", "recommendation")]
    return sized.select(
        *kept, F.when(is_size, F.col("severity")).otherwise("warning").alias("severity"),
        F.when(is_size & (F.col("role") == "migration"), "Keep the order and atomicity of migrations; review new ones by what they do, and never split applied ones.").otherwise(F.col("recommendation")).alias("recommendation"),
        F.struct("role", factor.alias("factor"), reason.alias("reason")).alias("context"), factor.alias("context_factor"),
    )


def relevance_order(findings: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Notices last, cycles first, then by raw penalty, rule, file, line, subject; adds raw_penalty."""
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("rule_id"))
    penalty = fn.raw_penalty(weight, fn.confidence_factor(F.col("confidence")), F.coalesce("context_factor", F.lit(1.0)))
    return findings.withColumn("raw_penalty", penalty).orderBy(
        (F.col("severity") == "info").asc(), (F.col("rule_id") != "runtime-cycle").asc(), F.desc("raw_penalty"), "rule_id", "file",
        F.coalesce("line", F.lit(0)), F.coalesce("subject", F.lit("")),
    )


def language_inventory(files: DataFrame, extra: list[str] = ()) -> DataFrame:
    """files(path, analyzed) -> name, mode, discovered, analyzed."""
    known = files.withColumn("name", fn.language(F.col("path"), list(extra))).filter("name IS NOT NULL")
    known = known.withColumn("mode", fn.language_mode(F.col("name")))
    return known.groupBy("name", "mode").agg(F.count(F.lit(1)).alias("discovered"), F.count_if("analyzed").alias("analyzed"))


def by_code(diagnostics: DataFrame, order: str, samples: int = 3) -> DataFrame:
    """code, n and the first samples: ranks are cut to the sample before rows of a code meet."""
    from pyspark.sql import Window

    ranked = diagnostics.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(order))).filter(F.col("_n") <= samples)
    first = ranked.groupBy("code").agg(F.sort_array(F.collect_list(order)).alias("samples"))
    return diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(first, "code")
