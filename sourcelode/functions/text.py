"""Scalar functions as Column expressions: paths, languages, text metrics, penalties."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONFIDENCE

# Language names and their file suffixes.
LANGUAGES = {
    "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs", "Python": "py pyi pyw", "Go": "go", "Rust": "rs",
    "Java": "java", "C": "c h", "C++": "cc cpp cxx hpp hxx hh", "C#": "cs", "Kotlin": "kt kts", "Swift": "swift",
    "Dart": "dart", "Ruby": "rb rake", "PHP": "php phtml", "Vue": "vue", "Svelte": "svelte", "Scala": "scala sc",
    "Elixir": "ex exs", "Erlang": "erl hrl", "Haskell": "hs lhs", "Lua": "lua", "Perl": "pl pm", "R": "r", "Julia": "jl",
    "Objective-C": "m mm", "Fortran": "f f90 f95", "Shell": "sh bash zsh", "PowerShell": "ps1 psm1", "SQL": "sql",
    "HTML": "html htm", "CSS": "css scss sass less", "Protocol Buffers": "proto", "Terraform": "tf hcl", "Zig": "zig",
    "OCaml": "ml mli", "Clojure": "clj cljs cljc", "F#": "fs fsx", "Bazel": "bzl", "Solidity": "sol", "Assembly": "s asm",
}
# Files without a suffix, and the languages that are parsed.
BAZEL_FILES = ("BUILD", "BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel")
SYNTAX_LANGUAGES = ("TypeScript", "JavaScript")
# Modules that come with the JavaScript runtime.
BUILTIN_MODULES = (
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns "
    "dns/promises domain events fs fs/promises http http2 https inspector inspector/promises module net os path path/posix "
    "path/win32 perf_hooks process punycode querystring readline readline/promises repl stream stream/consumers "
    "stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm "
    "wasi worker_threads zlib"
).split()
BUILTIN_ONLY_PREFIXED = ("node:sea", "node:sqlite", "node:test", "node:test/reporters")
# Suffixes of sources, what a written one can stand for in order of preference, and marks of generated files.
SOURCE_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SUFFIX_SOURCES = {".js": (".ts", ".tsx", ".js", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs"), ".jsx": (".tsx", ".jsx")}
LINE_END = r"\r\n|[\r\n\x{2028}\x{2029}]"
GENERATED = (
    r"(?i)^\s*(?://|/\*|\*|#|--|<!--|;|%).*(?:@generated\b|auto[- ]generated\b|automatically generated\b"
    r"|code generated.*do not edit|generated by.*do not edit)"
)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the file's name, unless that is its first character."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def suffix_languages(extra: list[str] = ()) -> dict[str, str]:
    known = {f".{s}": name for name, all_ in LANGUAGES.items() for s in all_.split()}
    return {e: f"Extension {e}" for e in extra} | known


def language(path: Column, extra: list[str] = ()) -> Column:
    pairs = [F.lit(x) for pair in suffix_languages(extra).items() for x in pair]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), extension(path)), F.when(basename(path).isin(*BAZEL_FILES), F.lit("Bazel"))
    )


def language_mode(name: Column) -> Column:
    return F.when(name.isin(*SYNTAX_LANGUAGES), "syntax").when(name.isNotNull(), "text")


def line_count(text: Column) -> Column:
    """Physical lines: a closing line end opens no further line."""
    parts = F.size(F.split(text, LINE_END, -1))
    return F.when(text == "", 0).otherwise(parts - F.when(text.rlike(r"[\r\n\x{2028}\x{2029}]\z"), 1).otherwise(0))


def is_generated(text: Column) -> Column:
    """A marker in a comment within the first 1,024 characters."""
    return F.exists(F.split(F.substring(text, 1, 1024), r"\r?\n"), lambda line: line.rlike(GENERATED))



def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def package_name(specifier: Column) -> Column:
    local = specifier.rlike(r"(?i)^(?:\.|/|#|[a-z][a-z0-9+.-]*:)")
    parts = F.split(specifier, "/")
    name = F.when(specifier.startswith("@"), F.concat_ws("/", F.slice(parts, F.lit(1), F.lit(2)))).otherwise(parts[0])
    return F.when(~local & (specifier != "") & name.rlike(r"(?i)^(@[a-z0-9_.-]+/)?[a-z0-9_.-]+$"), name)


def is_builtin(specifier: Column) -> Column:
    plain = F.regexp_replace(specifier, "^node:", "")
    return plain.isin(*BUILTIN_MODULES) | specifier.isin(*BUILTIN_ONLY_PREFIXED)


def candidate_paths(base: Column) -> Column:
    """Files that an extensionless or compiled path can mean, first choice first."""
    suffix = F.regexp_extract(base, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    swapped = F.array().cast("array<string>")
    for written, sources in reversed(SUFFIX_SOURCES.items()):
        swapped = F.when(suffix == written, F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(swapped)
    tail = [F.concat(base, F.lit(s)) for s in SOURCE_SUFFIXES]
    index = [F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), F.lit(f"index{s}")) for s in SOURCE_SUFFIXES]
    return F.concat(swapped, F.array(base, *tail, *index))



def resolved_path(importer: Column, specifier: Column) -> Column:
    joined = F.concat_ws("/", dirname(importer), specifier)
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1))
        .when(part == "..", F.lit(None).cast("array<string>"))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(parts.isNotNull(), F.array_join(parts, "/"))



def ancestors(directory: Column) -> Column:
    """A directory and those above it, the root ('') last."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def glob_regex(pattern: str) -> str:
    """For a path with '/' added: each '**' segment stands for any number of segments."""
    out = []
    for segment in pattern.split("/"):
        if segment == "**":
            out.append("(?:[^/]*/)*")
        else:
            out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment) + "/")
    return f"^{''.join(out)}$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Of any of the patterns; one regular expression, so the path is read once."""
    if not patterns:
        return F.lit(False)
    return F.concat(path, F.lit("/")).rlike("|".join(glob_regex(p) for p in patterns))


def excluded(path: Column, patterns: list[str]) -> Column:
    """As the file and as a directory."""
    return matches_glob(path, patterns) | matches_glob(F.concat(path, F.lit("/")), patterns)


def in_scope(path: Column, scopes: list[str], directory: bool = False) -> Column:
    if not scopes:
        return F.lit(True)
    out = F.lit(False)
    for s in scopes:
        out = out | (path == s) | path.startswith(f"{s}/")
        if directory:
            out = out | F.lit(s).startswith(F.concat(path, F.lit("/")))
    return out


def confidence_factor(confidence: Column) -> Column:
    pairs = [F.lit(x) for pair in CONFIDENCE.items() for x in pair]
    return F.element_at(F.create_map(*pairs), confidence)


def category_of(rule: Column, category: Column) -> Column:
    return F.when(rule == "runtime-cycle", "cycles").when(category == "unused", "unusedFiles").otherwise(category)


def raw_penalty(weight: Column, confidence: Column, factor: Column) -> Column:
    exact = weight.cast("decimal(12,6)") * confidence.cast("decimal(6,2)") * factor.cast("decimal(10,6)")
    return F.round(exact, 6).cast("decimal(18,6)")


def size_excess(lines: Column, limit: Column) -> Column:
    return F.least(F.greatest(lines / limit - 1, F.lit(0.0)), F.lit(1.0))


def size_factor(lines: Column, limit: Column, role_factor: Column) -> Column:
    return F.round(size_excess(lines, limit) * role_factor, 6)
