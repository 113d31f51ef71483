"""The whole analysis of repositories: facts, rules, context, score.

Sources come as a table files(repo_id, path, content, bytes), so one job can take any number of them.
Parsing runs in Arrow batches; everything after it is joins and aggregates over fact tables. `scan` is the
entry for one tree: it walks it, reads its configuration and manifests, and assembles a lazy Analysis.
"""

from __future__ import annotations

import os
import posixpath
import re
import signal
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.redaction import safe_text
from ..model import CATEGORIES, DEPENDENCY_SCHEMA, DIAGNOSTIC_SCHEMA, FORMULA_VERSION, RULES, SCHEMA_VERSION, VIEWS, Configuration, InputError
from ..operators import budgets, coverage, duplication, filters, graph, rules, score
from ..operators.common import written
from ..sources import manifest as mf
from ..sources import parse_ts, tree
from ..sources.tsconfig import TSConfig, configurations, resolve

TOKEN = "array<struct<file:string,idx:int,hash:string,line:int,column:int,end_line:int>>"
FUNCTION = "array<struct<file:string,name:string,line:int,column:int,end_line:int,lines:int>>"
EDGE = "array<struct<" + DEPENDENCY_SCHEMA.replace(" STRING", ":string").replace(" INT", ":int").replace(", ", ",") + ">>"
NOTE = "array<struct<" + DIAGNOSTIC_SCHEMA.replace(" STRING", ":string").replace(" INT", ":int").replace(", ", ",") + ">>"
PARSED = f"repo_id string, file string, valid boolean, generated boolean, lines int, dependencies {EDGE}, functions {FUNCTION}, tokens {TOKEN}, blocks array<struct<start:int,end:int>>, diagnostics {NOTE}"


class ParseTimeout(Exception):
    pass


@contextmanager
def interrupted_after(milliseconds: int | None):
    """Raises ParseTimeout inside the block when the time is up. Workers run their code on the main thread, where
    a timer's signal gets through between byte codes; elsewhere the block is not limited."""
    if not milliseconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise ParseTimeout

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, milliseconds / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse_one(path: str, content: str, limits: dict[str, int]) -> parse_ts.Parsed:
    """A file that takes too long, or that the parser fails on, costs its own rows only."""
    try:
        with interrupted_after(limits.get("maxParseTimeMs")):
            return parse_ts.parse(path, content, limits)
    except ParseTimeout:
        code, severity, message = "PARSE_TIMEOUT", "warning", "Parsing took longer than the limit; the file is not analysed."
    except (RecursionError, IndexError, KeyError, MemoryError) as error:
        code, severity, message = "PARSE_ERROR", "error", f"The parser failed ({type(error).__name__}); the file is not analysed."
    return parse_ts.Parsed(valid=False, diagnostics=[{"code": code, "severity": severity, "message": message, "file": path, "line": None, "column": None}])


def parse_files(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row a syntax file, with its facts nested; each fact table is an explode of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, content in zip(batch["repo_id"], batch["path"], batch["content"], strict=True):
                p = parse_one(path, content, limits)
                blocks = [{"start": a, "end": b} for a, b in p.blocks]
                rows.append((repo, path, p.valid, p.generated, p.lines, p.dependencies, p.functions, p.tokens, blocks, p.diagnostics))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return files.select("repo_id", "path", "content").mapInPandas(run, PARSED)


BUDGETS = {  # limit -> fact table it counts, code, message
    "maxDependencies": ("dependencies", "DEPENDENCY_LIMIT", "The references of this file are beyond the limit of all files; it is not analysed."),
    "maxEntries": ("functions", "METRIC_LIMIT", "The functions of this file are beyond the limit of all files; its metrics and bodies are partial."),
    "maxDuplicationTokens": ("tokens", "DUPLICATION_TOKEN_LIMIT", "The tokens of this file are beyond the limit of all files; duplicates in it are not assessed."),
}


def within_budgets(parsed: DataFrame, limits: dict[str, int]) -> tuple[DataFrame, bool]:
    """parsed without what the limits over all files of a repository leave no room for, and whether the limit of
    references was reached with files left, which ends a scan.

    Files count in order of their paths. References: a file that does not fit is left out, and later, smaller ones
    may fit. Functions: a file keeps those there is room for, and only their bodies. Tokens: a file that does not
    fit takes what room is left and has none. Only files' counts are folded, one task a repository.
    """
    sized = parsed.filter("valid AND NOT generated").select(
        "repo_id", "file", *[F.size(column).cast("long").alias(column) for column, _, _ in BUDGETS.values()]
    )
    totals = sized.groupBy("repo_id").agg(*[F.sum(c).alias(c) for c, _, _ in BUDGETS.values()])
    over = [F.col(c) >= limits[limit] if c == "dependencies" else F.col(c) > limits[limit] for limit, (c, _, _) in BUDGETS.items()]
    if not totals.filter(reduce(or_, over)).take(1):
        return parsed, False
    edges = budgets.skipping_budget(sized.select("repo_id", "file", "dependencies"), "repo_id", "dependencies", ["file"], limits["maxDependencies"])
    kept = sized.join(edges.select("repo_id", "file", F.col("within").alias("_fits"), F.col("before").alias("_edges")), ["repo_id", "file"])
    kept = kept.withColumn("_ended", F.col("_edges") >= limits["maxDependencies"])
    for column, limit in (("functions", "maxEntries"), ("tokens", "maxDuplicationTokens")):
        own = F.when(F.col("_fits"), F.col(column)).otherwise(0)
        room = F.lit(limits[limit]) - (running_total_in(own) - own)
        kept = kept.withColumn(f"_{column}", F.greatest(F.lit(0), room))
    room = kept.select("repo_id", "file", "_fits", "_ended", "_functions", "_tokens")
    joined = parsed.join(room, ["repo_id", "file"], "left")
    counted = F.coalesce("_fits", F.lit(False))
    out = joined.withColumn("valid", F.col("valid") & (F.coalesce("_fits", F.lit(True)) | F.col("generated")))
    cut, full = counted & (F.size("functions") > F.col("_functions")), counted & (F.size("tokens") > F.col("_tokens"))
    notes = F.array_compact(F.array(
        F.when(~F.coalesce("_fits", F.lit(True)) & ~F.coalesce("_ended", F.lit(False)), note_of("maxDependencies")),
        F.when(cut, note_of("maxEntries")), F.when(full, note_of("maxDuplicationTokens")),
    ))
    none = F.filter("tokens", lambda _: F.lit(False))
    bodies = F.when(cut, F.concat(F.slice("blocks", 1, 1), F.slice("blocks", F.lit(2), F.greatest(F.lit(0), F.col("_functions").cast("int"))))).otherwise(F.col("blocks"))
    out = out.select(
        "repo_id", "file", "valid", "generated", "lines", "dependencies",
        F.when(cut, F.slice("functions", F.lit(1), F.col("_functions").cast("int"))).otherwise(F.col("functions")).alias("functions"),
        F.when(full, none).otherwise(F.col("tokens")).alias("tokens"),
        F.when(full, F.filter("blocks", lambda _: F.lit(False))).otherwise(bodies).alias("blocks"),
        F.concat("diagnostics", notes).alias("diagnostics"),
    )
    return out, bool(room.filter("_ended").take(1))


def note_of(limit: str) -> Column:
    _, code, message = BUDGETS[limit]
    null = F.lit(None).cast("int")
    return F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit(message).alias("message"), F.col("file"), null.alias("line"), null.alias("column"))


def running_total_in(value: Column) -> Column:
    """Of counts by file, a repository's rows (at most maxFiles) in one task."""
    return F.sum(value).over(Window.partitionBy("repo_id").orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def explode(parsed: DataFrame, column: str) -> DataFrame:
    own = parsed.filter("valid AND NOT generated") if column != "diagnostics" else parsed
    return own.select("repo_id", F.inline(column))


# --- references --------------------------------------------------------------------------------------------


def configuration_table(spark: SparkSession, configs: dict[str, list[TSConfig]]) -> DataFrame:
    """The configurations of each repository as rows."""
    schema = "repo_id STRING, directory STRING, base STRING, supported BOOLEAN, aliases ARRAY<STRUCT<pattern: STRING, targets: ARRAY<STRING>>>"
    rows = [(repo, c.directory, c.base, c.supported, [(p, t) for p, t, _ in c.aliases]) for repo, own in configs.items() for c in own]
    return spark.createDataFrame(rows, schema)


def with_configurations(dependencies: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds base, aliases and supported of the nearest configuration above the importing file in its repository
    (null: none)."""
    directories = dependencies.select("repo_id", "from_file").distinct().select("repo_id", "from_file", fn.ancestors(fn.dirname(F.col("from_file"))).alias("above"))
    met = directories.select("repo_id", "from_file", F.explode("above").alias("directory")).join(configs, ["repo_id", "directory"])
    nearest = met.groupBy("repo_id", "from_file").agg(F.max_by(F.struct("base", "supported", "aliases"), F.length("directory")).alias("config"))
    return dependencies.join(nearest, ["repo_id", "from_file"], "left")


def resolve_references(dependencies: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """resolution, to_file and reason of each reference that is not indeterminate: dependencies(repo_id, from_file,
    specifier, ...), files(repo_id, path), configuration_table(). Each repository sees its own files alone.

    Candidates are made by columns (a cascade of cases), exploded in order and met with the files by an
    equi-join; the first that exists wins.
    """
    spec = F.col("specifier")
    rows = with_configurations(dependencies, configs).withColumn("_id", F.monotonically_increasing_id())

    def fits(a):
        at = F.instr(a["pattern"], "*")
        head, tail = F.substring_index(a["pattern"], "*", 1), F.substring_index(a["pattern"], "*", -1)
        wild = spec.startswith(head) & spec.endswith(tail) & (F.length(spec) >= F.length(a["pattern"]) - 1)
        return F.when(at == 0, a["pattern"] == spec).otherwise(wild)

    def ranked(a):
        at = F.instr(a["pattern"], "*")
        head, tail = F.substring_index(a["pattern"], "*", 1), F.substring_index(a["pattern"], "*", -1)
        captured = F.when(at == 0, "").otherwise(F.substr(spec, F.length(head) + 1, F.length(spec) - F.length(head) - F.length(tail)))
        rank = F.when(at == 0, -(1 << 30)).otherwise(-F.length(head))
        targets = F.transform(a["targets"], lambda t: F.when(F.instr(t, "*") > 0, F.concat(F.substring_index(t, "*", 1), captured, F.substring_index(t, "*", -1))).otherwise(t))
        return F.struct(rank.alias("rank"), a["pattern"].alias("pattern"), targets.alias("targets"))

    alias = F.get(F.array_sort(F.transform(F.filter(F.col("config.aliases"), fits), ranked)), F.lit(0))
    rows = rows.withColumn("_alias", alias)
    absolute = F.contains(spec, F.lit("\\")) | spec.startswith("/") | spec.rlike("(?i)^[a-z]:") | spec.startswith("file:")
    relative = spec.startswith(".")
    loader = F.contains(spec, F.lit("?")) | F.contains(spec, F.lit("!"))
    reason = (
        F.when(F.col("config.supported") == F.lit(False), "The TypeScript configuration is invalid or unsupported; the target is not confirmed.")
        .when((spec == "") | spec.rlike(r"[\x00-\x1f\x7f]"), "Empty references and control characters are not supported.")
        .when(absolute, "Absolute and file: references and other separators are not supported.")
        .when(relative | F.col("_alias").isNotNull(), F.lit(None).cast("string"))
        .when(spec.startswith("#"), "Imports of the package's own map are not supported.")
        .when(loader, "Loader references are not supported.")
    )
    base = F.when(F.col("config.base") == "", spec).otherwise(F.concat_ws("/", F.col("config.base"), spec))
    bases = (
        F.when(relative, F.array(fn.resolved_path(F.col("from_file"), spec)))
        .when(F.col("_alias").isNotNull(), F.transform(F.col("_alias.targets"), lambda t: fn.resolved_path(F.lit(""), t)))
        .when(F.col("config.base").isNotNull(), F.array(fn.resolved_path(F.lit(""), base)))
    )
    rows = rows.withColumn("_local", relative | F.col("_alias").isNotNull()).withColumn("_bases", F.when(reason.isNull(), bases)).withColumn("_reason", reason)
    escapes = F.exists("_bases", lambda b: b.isNull())
    rows = rows.withColumn("_reason", F.when(F.coalesce(escapes, F.lit(False)), "A local reference leaves the root.").otherwise(F.col("_reason")))
    listed = rows.filter("_reason IS NULL AND _bases IS NOT NULL").select("_id", "repo_id", F.posexplode(F.flatten(F.transform("_bases", fn.candidate_paths))).alias("_pos", "path"))
    found = listed.join(files.select("repo_id", "path").distinct(), ["repo_id", "path"]).groupBy("_id").agg(F.min_by("path", "_pos").alias("_found"))
    rows = rows.join(found, "_id", "left")
    open_ = F.col("resolution") == "indeterminate"
    missing = F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(F.col("_local") & F.col("_found").isNull(), "The local file is missing, excluded or of an unsupported format.")
    resolution = F.when(open_, F.col("resolution")).when(missing.isNotNull(), "unresolved").when(F.col("_found").isNotNull(), "internal").otherwise("external")
    keep = [c for c in dependencies.columns if c not in ("resolution", "to_file", "reason")]
    return rows.select(
        *keep, resolution.alias("resolution"), F.when(~open_ & missing.isNull(), F.col("_found")).alias("to_file"), F.when(open_, F.col("reason")).otherwise(missing).alias("reason")
    )


def reference_diagnostics(dependencies: DataFrame) -> DataFrame:
    own = dependencies.filter("resolution = 'unresolved'")
    code = F.when(F.col("reason").contains("leaves the root"), "ROOT_ESCAPE").otherwise("UNRESOLVED_REFERENCE")
    return own.select(code.alias("code"), F.lit("warning").alias("severity"), F.col("reason").alias("message"), F.col("from_file").alias("file"), "line", "column")


# --- entry points ------------------------------------------------------------------------------------------


def candidates(base: str) -> list[str]:
    """As functions.text.candidate_paths, for the few targets of manifests and configurations."""
    stem, suffix = posixpath.splitext(base)
    swapped = [stem + s for s in fn.SUFFIX_SOURCES.get(suffix.lower(), ())]
    return [*swapped, base, *(base + s for s in fn.SOURCE_SUFFIXES), *(posixpath.join(base, f"index{s}") for s in fn.SOURCE_SUFFIXES)]


@dataclass
class Project:
    entries: dict[tuple[str, str, str], str | None] = field(default_factory=dict)  # (file, origin, reason) -> purpose
    packages: list[tuple[str, str, str, list[str]]] = field(default_factory=list)
    tools: list[tuple[str, str, str]] = field(default_factory=list)
    uncertain_entries: bool = False
    uncertain_scripts: bool = False
    manifests: int = 0


class Locator:
    """Entry targets among the files of one repository (a driver-side list bounded by maxFiles)."""

    def __init__(self, files: list[str], configs: list[TSConfig]):
        self.files, self.known = files, set(files)
        self.configs = {c.directory: c for c in configs}

    def nearest(self, directory: str) -> TSConfig | None:
        while directory not in self.configs:
            if not directory:
                return None
            directory = posixpath.dirname(directory)
        return self.configs[directory]

    def find(self, directory: str, target: str) -> list[str]:
        base = resolve(directory, target)
        if base is None:
            return []
        bases = [base]
        config = self.nearest(directory)
        if config and config.supported and config.out_dir is not None and config.root_dir is not None and tree.is_inside(config.out_dir, base):
            bases.append(posixpath.normpath(posixpath.join(config.root_dir, posixpath.relpath(base, config.out_dir or "."))))
        bases += [re.sub(r"(?i)\.d\.([cm]?)ts$", r".\1ts", b) for b in bases]
        out = set()
        for b in dict.fromkeys(bases):
            if re.search(r"[?*]", b):
                pattern = re.compile("|".join(fn.glob_regex(c) for c in candidates(b)))
                out.update(f for f in self.files if pattern.match(f"{f}/"))
            else:
                out.update([c for c in candidates(b) if c in self.known][:1])
        return sorted(out)


def read_project(root_read, found: tree.Discovery, files: list[str], configs: list[TSConfig], config: Configuration) -> Project:
    out, locate = Project(), Locator(files, configs)

    def add(file: str, origin: str, reason: str, purpose: str | None = None) -> None:
        if len(out.entries) + len(out.packages) + len(out.tools) >= config.limits["maxEntries"]:
            raise InputError("PROJECT_LIMIT", "The limit of project facts was reached.")
        out.entries.setdefault((file, origin, reason), purpose)

    for pattern in config.entry_points:
        matches = locate.find("", pattern)
        if not matches:
            out.uncertain_entries = True
            found.note("ENTRY_NOT_FOUND", "A configured entry point matches no analysed source.", tree.CONFIG_FILE)
        for file in matches:
            add(file, "configured", "Named in the configuration.")
    directories = {""}
    for path in found.manifests:
        out.manifests += 1
        if out.manifests > config.limits["maxFiles"]:
            found.note("MANIFEST_LIMIT", "The limit of manifests was reached.")
            out.uncertain_entries = True
            break
        directory = posixpath.dirname(path)
        directories.add(directory)
        try:
            own = mf.parse_manifest(path, root_read(path))
        except InputError as error:
            if error.code == "TOTAL_BYTES_LIMIT":
                raise
            out.uncertain_entries = True
            found.note(error.code, error.message, path, "error")
            continue
        except OSError:
            out.uncertain_entries = True
            found.note("READ_ERROR", "The file could not be read safely.", path, "error")
            continue
        for problem in own.problems:
            out.uncertain_entries = True
            found.note("INVALID_MANIFEST", problem, path, "error")
        out.packages += [(name, path, directory, sections) for name, sections in own.packages.items()]
        for target in own.targets:
            matches = locate.find(directory, target)
            if not matches:
                out.uncertain_entries = True
                found.note("ENTRY_NOT_FOUND", "A public entry has no source.", path)
            for file in matches:
                add(file, "public-api", f"Public entry of {path}.")
        unclear = False
        for name, facts in own.scripts.items():
            out.tools += [(tool, path, name) for tool in facts.tools]
            out.uncertain_scripts |= facts.uncertain
            unclear |= facts.unknown_directory
            for target, required, purpose in facts.entries:
                matches = locate.find(directory, target)
                unclear |= required and not matches
                for file in matches:
                    add(file, "script", f"Run by script {name} of {path}.", purpose)
        if unclear:
            out.uncertain_scripts = True
            found.note("SCRIPT_UNCERTAIN", "A script's entry is missing or its directory is unknown; scripts were not run.", path)
        inside = [(f, f[len(directory) + 1 :] if directory else f) for f in files if tree.is_inside(directory, f) or not directory]
        configs_of = [stem for package, stem in mf.TOOL_CONFIGS.items() if package in own.packages]
        for file, local in inside:
            if "next" in own.packages and mf.NEXT_ROUTE.match(local):
                add(file, "framework", f"Route convention of {path}.")
            if any(re.match(rf"{s}\.config\.[cm]?[jt]s\Z", local) for s in configs_of):
                add(file, "framework", f"Tool configuration of {path}.")
    for directory in sorted(directories):
        for stem in mf.CONVENTIONS:
            for file in locate.find(directory, stem):
                add(file, "convention", "Entry by convention.")
    for file in files:
        if re.search(r"(?:^|/)(?:test|tests|__tests__)/|\.(?:test|spec)\.[cm]?[jt]sx?$", file):
            add(file, "test", "Test by convention.")
    return out


# --- the analysis ------------------------------------------------------------------------------------------


@dataclass
class Analysis:
    root: str
    config: Configuration
    status: str
    tables: dict[str, DataFrame]
    category_coverage: dict[str, tuple[str, str | None]]
    counters: dict[str, int]
    ignore_files: list[str]
    score: dict
    view: str = "scan"
    schema_version: str = SCHEMA_VERSION
    formula_version: str = FORMULA_VERSION
    limitations: list[str] = field(default_factory=list)

    def select(self, view: str) -> Analysis:
        """Other findings, same score and facts."""
        from dataclasses import replace

        return replace(self, tables=self.tables | {"findings": filters.view(self.tables["all_findings"], view)}, view=view)


LIMITATIONS = [
    "Code is read, never run: what happens at runtime is not known.",
    "Structure comes from TypeScript and JavaScript; other languages are compared as text.",
    "References without a literal argument have no target.",
    "A file or package without references can have users outside of the tree.",
    "Duplicates are exact: tokens or whole texts.",
    "The score weighs signals; it is no proof of a defect.",
    "Syntax is checked as far as lexical structure, brackets and declarations show it.",
    "Scripts and configurations are read as data.",
]


TEXT_LIMITATION = "Other languages than TypeScript and JavaScript have line counts and are compared whole; their references, functions, packages and blocks are not interpreted."


def run_rules(spark: SparkSession, found: tree.Discovery, project: Project, facts: dict[str, DataFrame], config: Configuration, counts: dict, early: bool) -> tuple[DataFrame, dict[str, DataFrame], dict]:
    files, dependencies = facts["analyzed"], facts["dependencies"]
    uncertain = bool(counts["text"] or project.uncertain_entries or project.uncertain_scripts or counts["diagnostics"] or counts["open"])
    entries = spark.createDataFrame([(f, o, r, p) for (f, o, r), p in sorted(project.entries.items())], "file STRING, origin STRING, reason STRING, purpose STRING")
    packages = spark.createDataFrame(project.packages, "name STRING, manifest STRING, directory STRING, sections ARRAY<STRING>")
    tools = spark.createDataFrame(project.tools, "name STRING, manifest STRING, script STRING")

    inner = filters.runtime_edges(dependencies, runtime_only=False)
    syntax = facts["parsed"].filter("valid AND NOT generated").select(F.col("file").alias("path"))
    reached = graph.reachable(inner, entries.select(F.col("file").alias("node")))
    usage = graph.file_usage(syntax, reached, bool(project.entries), uncertain)
    unread = facts["text_files"].select(
        F.col("path").alias("file"), F.lit("unknown").alias("state"), F.lit("UNKNOWN").alias("confidence"),
        F.lit("A text file: what it refers to is not interpreted.").alias("reason"),
    )

    components = graph.strong_components(filters.runtime_edges(dependencies))
    capped = graph.capped_components(components, config.limits["maxFindings"])

    outside = dependencies.filter("resolution = 'external' AND specifier IS NOT NULL").withColumn("name", fn.package_name(F.col("specifier"))).filter("name IS NOT NULL")
    outside = outside.withColumn("_edge", F.struct("from_file", "line", "column", "kind", "specifier"))
    from ..operators import joins

    owned = joins.longest_prefix_owner(outside, ["_edge"], packages)
    proof = owned.select("name", "manifest", F.when(fn.is_builtin(F.col("specifier")), "unknown").otherwise(F.col("kind")).alias("kind"), F.col("from_file").alias("file"), "line")
    proof = proof.unionByName(tools.join(packages.select("name", "manifest"), ["name", "manifest"]).select("name", "manifest", F.lit("script").alias("kind"), F.col("manifest").alias("file"), F.lit(None).cast("int").alias("line")))
    package_usage = rules.package_usage(packages, proof, uncertain)
    evidence = proof.distinct().groupBy("name", "manifest").agg(F.sort_array(F.collect_list(F.struct("file", "line", "kind"))).alias("evidence"))
    package_usage = package_usage.join(evidence, ["name", "manifest"], "left")

    limits = config.duplication
    sequences = duplication.block_sequences(facts["tokens"], facts["blocks"], limits["minTokens"], limits["minLines"])
    groups = duplication.group_rows(duplication.without_nested(duplication.token_groups(sequences)))
    texts = facts["text_files"].select(F.col("path").alias("file"), F.col("content").alias("text"))
    text_candidates = duplication.text_candidates(texts, limits["minLines"], limits["minBytes"])
    text_members = duplication.verified_occurrences(texts, text_candidates, duplication.text_groups(text_candidates))
    where = F.struct("file", F.lit(1).alias("line"), F.lit(1).alias("column"), F.col("lines").alias("end_line"))
    text_groups = text_members.groupBy("hash", "bytes", "group_file").agg(F.sort_array(F.collect_list(where)).alias("blocks")).filter(F.size("blocks") > 1)
    text_groups = text_groups.select(
        F.concat_ws(":", F.lit("duplicate-text"), "hash", "group_file").alias("id"), F.lit(0).alias("tokens"), F.col("group_file").alias("file"),
        F.lit(1).alias("line"), F.transform("blocks", lambda b: b["file"]).alias("related_files"), "blocks",
    )

    found_rows = [
        rules.cycle_findings(capped),
        rules.unused_files(usage, len(project.entries)),
        rules.unused_packages(package_usage),
        rules.oversized_files(facts["file_metrics"], config.thresholds["fileLines"]).drop("observed"),
        rules.oversized_functions(facts["functions"], config.thresholds["functionLines"]).drop("observed"),
        rules.duplicate_findings(groups, "Blocks of equal tokens", "A whole file or function body; comments and white space aside."),
        rules.duplicate_findings(text_groups, "Files of equal text", "Whole texts, compared as such."),
    ]
    findings = found_rows[0]
    for more in found_rows[1:]:
        findings = findings.unionByName(more)

    tests = entries.filter("origin = 'test' OR purpose = 'test'").select("file").distinct().withColumn("_test", F.lit(True))
    tool = entries.filter((F.col("origin") == "script") & (F.coalesce("purpose", F.lit("")) != "application") | (F.col("origin") == "framework") & F.col("file").rlike(rules.TOOL_CONFIG))
    tool = tool.select("file").distinct().withColumn("_tool", F.lit(True))
    marked = entries.join(tests, "file", "left").join(tool, "file", "left")
    testlike = F.col("_test").isNotNull() | F.col("file").rlike(rules.TEST_PATH)
    production = marked.filter(
        F.col("origin").isin("configured", "public-api", "convention") | (F.coalesce("purpose", F.lit("")) == "application")
        | (F.col("origin") != "test") & ~testlike & F.col("_tool").isNull()
    )
    runtime = graph.reachable(filters.runtime_edges(dependencies), production.select(F.col("file").alias("node"))).select(F.col("node").alias("file"), F.lit(True).alias("_runtime"))
    named = files.select(F.col("path").alias("file")).unionByName(packages.select(F.col("manifest").alias("file"))).distinct()
    roles = named.join(runtime, "file", "left").join(tests, "file", "left").join(tool, "file", "left")
    role = rules.role(F.col("file"), F.col("_runtime").isNotNull(), testlike, F.col("file").rlike(rules.MIGRATION_PATH), F.col("_tool").isNotNull())
    roles = roles.select("file", role.alias("role"))

    null = F.lit(None).cast("int")
    sizes = facts["file_metrics"].select(F.lit("oversized-file").alias("rule_id"), "file", null.alias("line"), null.alias("column"), "lines").unionByName(
        facts["functions"].select(F.lit("oversized-function").alias("rule_id"), "file", "line", "column", "lines")
    )
    findings = rules.contextualized(findings, roles, sizes, config.thresholds["fileLines"], config.thresholds["functionLines"])
    tables = {"entry_points": entries, "file_usage": usage.unionByName(unread), "package_usage": package_usage, "components": components, "duplicates": groups.unionByName(text_groups), "roles": roles}
    return findings, tables, {"uncertain": uncertain}


@contextmanager
def deadline(spark: SparkSession, seconds: float, cancelled: threading.Event | None):
    """Jobs that the block starts are cancelled when the time is up or the event is set. Yields a function that
    tells the code of what happened, if anything did."""
    context, group, why = spark.sparkContext, f"scan-{uuid.uuid4().hex}", []
    finished, ends = threading.Event(), time.monotonic() + seconds

    def watch() -> None:
        while not finished.wait(0.05):
            if cancelled is not None and cancelled.is_set():
                why.append("CANCELLED")
            elif time.monotonic() > ends:
                why.append("SCAN_TIMEOUT")
            if why:
                context.cancelJobGroup(group)

    context.setJobGroup(group, "scan", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield lambda: why[0] if why else None
    finally:
        finished.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)


JOB_ALLOWANCE = 10
STOPPED = {"CANCELLED": "The scan was cancelled.", "SCAN_TIMEOUT": "The time limit of the scan was reached."}


def scan(spark: SparkSession, root: str, profile: str | None = None, scope: list[str] | None = None, deadline_ms: int | None = None, cancelled: threading.Event | None = None) -> Analysis:
    """Analyses one tree. Configuration errors raise InputError; all else becomes diagnostics. The deadline and the
    event `cancelled` cover the walk, parsing and rules; a scan that they stop is partial and has no findings.
    Without deadline_ms the configuration's timeoutMs holds for the walk, and JOB_ALLOWANCE times that for all of
    the scan, since the fixed costs of its jobs are not the tree's."""
    root = os.path.abspath(root)
    if os.path.islink(root) or not os.path.isdir(root):
        raise InputError("INVALID_ROOT", "The root must be a directory, and no link.")
    config = tree.read_configuration(root, None, profile)
    if scope:
        from ..sources.config import valid_scope

        config.scope = valid_scope(list(scope))
    budget = tree.Budget(config.limits["maxTotalBytes"])
    walk = (config.limits["timeoutMs"] if deadline_ms is None else deadline_ms) / 1000
    seconds = walk * JOB_ALLOWANCE if deadline_ms is None else walk
    found = tree.Discovery()
    read = lambda path: tree.safe_read(root, path, tree.SMALL, budget)
    with deadline(spark, seconds, cancelled) as stopped:
        try:
            found, files, configs, aborted = acquired(spark, root, config, budget, read, time.monotonic() + walk)
            result = analyze(spark, root, files, found, configs, config, read, aborted)
            if not stopped():
                return result
        except (PySparkException, Py4JError):
            if not stopped():
                raise
    if not any(d["code"] == stopped() for d in found.diagnostics):
        found.note(stopped(), STOPPED[stopped()])
    return analyze(spark, root, spark.createDataFrame([], tree.FILES), found, [], config, read, True)


def acquired(spark: SparkSession, root: str, config: Configuration, budget: tree.Budget, read, ends: float) -> tuple[tree.Discovery, DataFrame, list[TSConfig], bool]:
    """The walk, configurations and files of a tree; whether a limit of the whole scan ended it."""
    found, configs = tree.Discovery(), []
    try:
        found = tree.discover(root, config, budget, ends)
        configs = configurations(found.configs, read, config, found.note)
        files = tree.read_files(spark, root, found, config, budget)
        return found, files, configs, any(d["code"] == "TOTAL_BYTES_LIMIT" for d in found.diagnostics)
    except InputError as error:
        found.note(error.code, error.message, None, "error")
        return found, spark.createDataFrame([], tree.FILES), configs, True


def analyze(spark: SparkSession, root: str, files: DataFrame, found: tree.Discovery, configs: list[TSConfig], config: Configuration, read, aborted: bool = False) -> Analysis:
    name = fn.language(F.col("path"), config.source_extensions)
    marked = files.withColumn("language", name).withColumn("mode", fn.language_mode(F.col("language"))).withColumn("generated", fn.is_generated(F.col("content")))
    files = written(marked, "files")
    own = files.filter("NOT generated")
    alone = {k: v for k, v in config.limits.items() if k != "maxDuplicationTokens"}  # counted over all files
    parsed = written(parse_files(own.filter("mode = 'syntax'"), alone), "parsed")
    fitting, ended = within_budgets(parsed, config.limits)
    parsed = written(fitting, "fitting") if fitting is not parsed else parsed
    if ended:
        found.note("DEPENDENCY_LIMIT", "The limit of references over all files was reached.", None, "error")
        aborted = True
    text_files = own.filter("mode = 'text'")
    found.skipped += files.filter("generated").count() + parsed.filter("generated").count()
    syntax = parsed.filter("valid AND NOT generated")
    analyzed = syntax.select(F.col("file").alias("path")).unionByName(text_files.select("path"))
    raw = explode(parsed, "dependencies")
    dependencies = written(resolve_references(raw, syntax.select("repo_id", F.col("file").alias("path")), configuration_table(spark, {"": configs})), "dependencies")
    metrics = syntax.select("file", "lines").unionByName(text_files.select(F.col("path").alias("file"), fn.line_count(F.col("content")).alias("lines")))
    own_notes = explode(parsed, "diagnostics").drop("repo_id").unionByName(reference_diagnostics(dependencies))
    facts = {
        "files": files, "parsed": parsed, "analyzed": analyzed, "text_files": text_files, "dependencies": dependencies, "file_metrics": metrics,
        "functions": explode(parsed, "functions").drop("repo_id"), "tokens": explode(parsed, "tokens").drop("repo_id"),
        "blocks": syntax.select("file", F.inline("blocks")),
    }
    early = len(found.diagnostics) + own_notes.count()
    syntax_count, text_count = syntax.count(), text_files.count()
    try:
        project = Project() if aborted else read_project(read, found, sorted(r["file"] for r in syntax.select("file").toLocalIterator()), configs, config)
    except InputError as error:
        found.note(error.code, error.message, None, "error")
        project, aborted = Project(), True
    diagnostics = spark.createDataFrame([tuple(d.values()) for d in found.diagnostics], DIAGNOSTIC_SCHEMA).unionByName(own_notes)
    counts = {"text": text_count, "diagnostics": len(found.diagnostics) + early, "open": dependencies.filter("resolution IN ('indeterminate', 'unresolved')").limit(1).count()}
    findings, tables, flags = run_rules(spark, found, project, facts, config, counts, bool(early))
    if aborted:
        findings = findings.limit(0)
    findings = written(findings, "findings")
    total_findings = findings.count()
    any_notes = len(found.diagnostics) + own_notes.count() > 0
    if total_findings > config.limits["maxFindings"]:
        any_notes = True
        note = [("FINDING_LIMIT", "warning", "More findings than the limit; the most relevant ones are kept.", None, None, None)]
        diagnostics = diagnostics.unionByName(spark.createDataFrame(note, DIAGNOSTIC_SCHEMA))
    ordered = rules.relevance_order(findings, config.weights).limit(config.limits["maxFindings"])
    states = coverage.categories(
        syntax_files=syntax_count, text_files=text_count, entries=len(project.entries), manifests=project.manifests, early_diagnostics=bool(early),
        any_diagnostics=any_notes, uncertain=flags["uncertain"],
        unknown_packages=tables["package_usage"].filter("state = 'unknown'").limit(1).count() > 0,
        duplication_complete=not own_notes.filter("code IN ('DUPLICATION_TOKEN_LIMIT', 'METRIC_LIMIT')").take(1),
        components_truncated=tables["components"].count() > config.limits["maxFindings"], aborted=aborted,
    )
    coverage_rows = spark.createDataFrame([(c, *states[c]) for c in CATEGORIES], "category STRING, status STRING, reason STRING")
    contributions = score.contributions(ordered, config.weights).withColumn("_all", F.lit(1))
    allocated = score.allocate(contributions, config.caps, keys=["_all"]).drop("_all")
    result = score.final_score(allocated, coverage_rows, syntax_count + text_count).first()
    languages = rules.language_inventory(files.select("path", F.lit(False).alias("analyzed")), config.source_extensions).drop("analyzed")
    done = rules.language_inventory(analyzed.select("path", F.lit(True).alias("analyzed")), config.source_extensions).select("name", "analyzed")
    languages = languages.join(done, "name", "left").na.fill(0, ["analyzed"]).orderBy("name")
    tables |= {
        "findings": ordered, "all_findings": ordered, "diagnostics": diagnostics.orderBy("file", "line", "code"), "score_contributions": allocated,
        "category_coverage": coverage_rows, "languages": languages, "dependencies": dependencies.orderBy("from_file", "line", "column", "kind"),
        "files": analyzed.orderBy("path"), "file_metrics": metrics.orderBy("file"), "functions": facts["functions"],
    }
    counters = {"discovered": len(found.files), "analyzed": syntax_count + text_count, "skipped": found.skipped, "bytes_read": files.agg(F.sum("bytes")).first()[0] or 0, "total_findings": total_findings}
    limitations = LIMITATIONS + ([TEXT_LIMITATION] if text_count else []) + ([f"Only the scope was read: {', '.join(map(safe_text, config.scope))}."] if config.scope else [])
    return Analysis(root, config, "partial" if any_notes or aborted else "complete", tables, states, counters, found.ignore_files, result.asDict(), limitations=limitations)


def exit_code(result: Analysis) -> int:
    """2 if anything was not acquired, else 1 with findings, else 0."""
    return 2 if result.status != "complete" else int(bool(result.tables["findings"].take(1)))


__all__ = ["RULES", "VIEWS", "Analysis", "analyze", "exit_code", "resolve_references", "scan"]
