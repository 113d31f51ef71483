"""Source trees as tables: a contained walk with pruning, and safe reads."""

from __future__ import annotations

import os
import re
import stat
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BAZEL_FILES, glob_regex, suffix_languages
from ..model import CONFIG_FILE, IGNORE_FILE, Configuration, InputError
from .config import parse_configuration

FILES = "repo_id STRING, path STRING, content STRING, bytes BIGINT"
SMALL, MAX_RULES = 65_536, 10_000


def is_inside(root: str, path: str) -> bool:
    """By names, not by characters."""
    return path == root or path.startswith(root.rstrip("/") + "/")


@dataclass
class Rule:
    regex: re.Pattern
    negated: bool
    only_directories: bool

    def matches(self, path: str, is_dir: bool) -> bool:
        return bool(self.regex.match(f"{path}/" if is_dir and self.only_directories else path))


def ignore_rules(source: str) -> list[Rule]:
    """Lines of an ignore file, in order, as patterns of paths relative to its directory."""
    out = []
    for line in re.split(r"\r?\n", source):
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        only_dir = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        if not body:
            continue
        out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _ignore_regex(body) + ("/.*" if only_dir else "(?:/.*)?") + r"\Z", re.DOTALL), negated, only_dir))
    return out


def _ignore_regex(body: str) -> str:
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i < len(body) and body[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]/]*)\]").match(body, i)):
            out, i = out + f"[{'^' if m.group(1) else ''}{re.sub(r'([\\\]])', r'\\\1', m.group(2))}]", m.end()
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass
class Budget:
    """Bytes of all reads together."""

    left: int

    def take(self, n: int) -> None:
        if n > self.left:
            raise InputError("TOTAL_BYTES_LIMIT", "The limit of bytes in all was reached.")
        self.left -= n


def safe_read(root: str, relative: str, limit: int, budget: Budget | None = None) -> str:
    """A regular file under the root, without links on the way, of strict UTF-8 (a byte order mark stays)."""
    path = os.path.join(root, relative)
    if not is_inside(root, os.path.normpath(path)):
        raise InputError("ROOT_ESCAPE", "A path outside of the root was rejected.")
    at = root
    for part in relative.split("/"):
        at = os.path.join(at, part)
        if stat.S_ISLNK(os.lstat(at).st_mode):
            raise InputError("LINK_SKIPPED", "A symbolic link was not followed.")
    fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with os.fdopen(fd, "rb") as f:
        before = os.fstat(fd)
        if not stat.S_ISREG(before.st_mode):
            raise InputError("READ_ERROR", "Not a regular file.")
        if before.st_size > limit:
            raise InputError("FILE_LIMIT", "The file is larger than the limit.")
        if budget:
            budget.take(before.st_size)
        data = f.read(limit + 1)
        after = os.fstat(fd)
    if len(data) > limit:
        raise InputError("FILE_LIMIT", "The file is larger than the limit.")
    if (before.st_ino, before.st_mtime_ns, before.st_size) != (after.st_ino, after.st_mtime_ns, after.st_size):
        raise InputError("READ_ERROR", "The file changed while it was read.")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise InputError("READ_ERROR", "The file is not valid UTF-8.") from None


@dataclass
class Discovery:
    files: list[str] = field(default_factory=list)
    configs: list[str] = field(default_factory=list)
    manifests: list[str] = field(default_factory=list)
    ignore_files: list[str] = field(default_factory=list)
    skipped: int = 0
    diagnostics: list[dict] = field(default_factory=list)

    def note(self, code: str, message: str, file: str | None = None, severity: str = "warning") -> None:
        self.diagnostics.append({"code": code, "severity": severity, "message": message, "file": file, "line": None, "column": None})


def read_configuration(root: str, budget: Budget | None = None, profile: str | None = None) -> Configuration:
    try:
        source = safe_read(root, CONFIG_FILE, SMALL, budget)
    except FileNotFoundError:
        return Configuration(profile or "standard")
    return parse_configuration(source, profile)


def has_language(name: str, config: Configuration) -> bool:
    stem, dot, suffix = name.rpartition(".")
    return bool(stem and dot and f".{suffix.lower()}" in suffix_languages(config.source_extensions)) or name in BAZEL_FILES


def discover(root: str, config: Configuration, budget: Budget | None = None, deadline: float | None = None) -> Discovery:
    """Walks the tree, entries in order, and never enters what is excluded, ignored or out of scope."""
    out = Discovery()
    excluded = re.compile("|".join(glob_regex(p) for p in config.exclude)) if config.exclude else None
    entries_seen = rules_seen = 0

    def in_scope(path: str, directory: bool) -> bool:
        return not config.scope or any(path == s or path.startswith(f"{s}/") or (directory and s.startswith(f"{path}/")) for s in config.scope)

    stack: list[tuple[str, int, list[tuple[str, list[Rule]]]]] = [("", 0, [])]
    while stack:
        if deadline and time.monotonic() > deadline:
            out.note("SCAN_TIMEOUT", "The time limit of the scan was reached.", None, "error")
            break
        directory, depth, layers = stack.pop()
        if depth > config.limits["maxDepth"]:
            out.note("DEPTH_LIMIT", "The limit of depth was reached.", directory)
            out.skipped += 1
            continue
        absolute = os.path.join(root, directory) if directory else root
        try:
            if os.path.islink(absolute) or not is_inside(os.path.realpath(root), os.path.realpath(absolute)):
                raise InputError("ROOT_ESCAPE", "An unsafe directory was rejected.")
            own = list(layers)
            for name in ([".gitignore"] if config.respect_gitignore else []) + [IGNORE_FILE]:
                relative = f"{directory}/{name}" if directory else name
                try:
                    source = safe_read(root, relative, SMALL, budget)
                except FileNotFoundError:
                    continue
                rules_seen += len(re.split(r"\r?\n", source))
                if rules_seen > MAX_RULES:
                    raise InputError("IGNORE_LIMIT", "The limit of ignore rules was reached; the directory is not entered.")
                own.append((directory, ignore_rules(source)))
                out.ignore_files.append(relative)
            names = []
            with os.scandir(absolute) as entries:
                for entry in entries:
                    entries_seen += 1
                    if entries_seen > config.limits["maxEntries"]:
                        out.note("ENTRY_LIMIT", "The limit of directory entries was reached.")
                        out.skipped += 1
                        return _sorted(out)
                    names.append(entry.name)
            for name in sorted(names):
                path = f"{directory}/{name}" if directory else name
                if excluded and (excluded.match(f"{path}/") or excluded.match(f"{path}//")):
                    out.skipped += 1
                    continue
                mode = os.lstat(os.path.join(root, path)).st_mode
                is_dir = stat.S_ISDIR(mode)
                if not in_scope(path, is_dir) and name not in ("tsconfig.json", "package.json"):
                    out.skipped += 1
                    continue
                if _is_ignored(path, is_dir, own):
                    out.skipped += 1
                elif stat.S_ISLNK(mode):
                    out.note("LINK_SKIPPED", "A symbolic link was not followed.", path)
                    out.skipped += 1
                elif is_dir:
                    stack.append((path, depth + 1, own))
                elif not stat.S_ISREG(mode):
                    out.skipped += 1
                else:
                    if name == "tsconfig.json":
                        out.configs.append(path)
                    if name == "package.json":
                        out.manifests.append(path)
                    if not in_scope(path, False) or not has_language(name, config):
                        out.skipped += 1
                    elif len(out.files) >= config.limits["maxFiles"]:
                        out.note("FILE_COUNT_LIMIT", "The limit of source files was reached.")
                        out.skipped += 1
                        return _sorted(out)
                    else:
                        out.files.append(path)
        except InputError as error:
            if error.code == "TOTAL_BYTES_LIMIT":
                raise
            out.note(error.code, error.message, directory, "error")
        except OSError:
            out.note("READ_ERROR", "The directory could not be read safely.", directory, "error")
    for scope in config.scope:
        if not any(f == scope or f.startswith(f"{scope}/") for f in out.files):
            out.note("EMPTY_SCOPE", "A scope holds no source file.", scope)
    return _sorted(out)


def _is_ignored(path: str, is_dir: bool, layers: list[tuple[str, list[Rule]]]) -> bool:
    ignored = False
    for directory, rules in layers:
        local = path[len(directory) + 1 :] if directory else path
        for rule in rules:
            if rule.matches(local, is_dir):
                ignored = not rule.negated
    return ignored


def _sorted(out: Discovery) -> Discovery:
    for names in (out.files, out.configs, out.manifests, out.ignore_files):
        names.sort()
    return out


def read_files(spark: SparkSession, root: str, found: Discovery, config: Configuration, budget: Budget, repo_id: str = "") -> DataFrame:
    """files(repo_id, path, content, bytes); what cannot be read goes to found.diagnostics, and where the limit of
    bytes in all ends it, the files before are kept. The walk and its
    limits (64 to 256 MB in all) belong to one tree on the driver's file system; trees that Spark can read
    itself, or any number of them, come in as such a table from elsewhere (read_tree_files)."""
    rows = []
    for path in found.files:
        try:
            content = safe_read(root, path, config.limits["maxFileBytes"], budget)
            if "\0" in content:
                raise InputError("BINARY_SOURCE", "The file holds NUL characters.")
            rows.append((repo_id, path, content, len(content.encode())))
        except InputError as error:
            found.note(error.code, error.message, path, "error")
            if error.code == "TOTAL_BYTES_LIMIT":
                break
        except OSError:
            found.note("READ_ERROR", "The file could not be read safely.", path, "error")
    return spark.createDataFrame(rows, FILES)


def read_tree_files(spark: SparkSession, glob: str, root: str, repo_id: str = "") -> DataFrame:
    """The same table of a tree in any store that Spark reads: one row a file of valid UTF-8 without NUL."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.lit(repo_id).alias("repo_id"), path.alias("path"), text.alias("content"), F.col("length").alias("bytes")).filter(
        F.col("content").isNotNull() & ~F.contains("content", F.lit("\0"))
    )
