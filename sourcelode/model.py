"""Configuration, limits and the fixed vocabulary of findings."""

from __future__ import annotations

from dataclasses import dataclass, field

# Rules, categories, views and how much a confidence counts.
RULES = ("runtime-cycle", "potentially-unused-file", "potentially-unused-package", "oversized-file", "oversized-function", "duplicate-block")
CATEGORIES = ("cycles", "unusedFiles", "packages", "size", "duplication")
VIEWS = {
    "scan": RULES,
    "architecture": ("runtime-cycle",),
    "duplicates": ("duplicate-block",),
    "dead-code": ("potentially-unused-file", "potentially-unused-package"),
}
CONFIDENCE = {"CONFIRMED": 1.0, "LIKELY": 0.75, "SUSPICIOUS": 0.25, "UNKNOWN": 0.0}
CONFIG_FILE, IGNORE_FILE = ".sourcelode.yml", ".sourcelodeignore"
SCHEMA_VERSION, FORMULA_VERSION = "1.3", "1.1"

# Directories and files that are no sources of a project.
EXCLUSIONS = (
    "**/.git/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/coverage/**", "**/.next/**",
    "**/.nuxt/**", "**/.cache/**", "**/.tmp/**", "**/*.d.ts", "**/*.d.mts", "**/*.d.cts", "**/*.min.js",
    "**/*.generated.*", "**/.npm-cache/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/.gradle/**",
    "**/.terraform/**", "**/target/**", "**/obj/**", "**/vendor/**",
)
# Fixed values: (standard, large) limits; the large ones are the ceilings of what a configuration can ask for.
LIMITS = {
    "maxFiles": (10_000, 100_000), "maxEntries": (100_000, 1_000_000), "maxDepth": (64, 128),
    "maxFileBytes": (2_097_152, 8_388_608), "maxTotalBytes": (67_108_864, 268_435_456), "maxParseTimeMs": (5_000, 30_000),
    "maxAstNodes": (200_000, 1_000_000), "maxDependencies": (100_000, 1_000_000), "maxFindings": (1_000, 10_000),
    "timeoutMs": (60_000, 300_000), "maxDuplicationTokens": (200_000, 2_000_000),
    "maxDuplicationBlocks": (10_000, 100_000), "maxDuplicationComparisons": (5_000_000, 20_000_000),
}
# Weights of rules and caps of categories.
WEIGHTS = {"runtime-cycle": 8, "potentially-unused-file": 2, "potentially-unused-package": 3, "oversized-file": 4, "oversized-function": 2, "duplicate-block": 5}
CAPS = {"cycles": 30, "unusedFiles": 15, "packages": 15, "size": 20, "duplication": 20}


class InputError(Exception):
    """Rejected input: becomes a diagnostic row."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass
class Configuration:
    profile: str = "standard"
    scope: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    source_extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(EXCLUSIONS))
    entry_points: list[str] = field(default_factory=list)
    limits: dict[str, int] = field(default_factory=dict)
    thresholds: dict[str, int] = field(default_factory=lambda: {"fileLines": 300, "functionLines": 50})
    duplication: dict[str, int] = field(default_factory=lambda: {"minTokens": 50, "minLines": 5, "minBytes": 100})
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    caps: dict[str, float] = field(default_factory=lambda: dict(CAPS))

    def __post_init__(self):
        chosen = 1 if self.profile == "large" else 0
        self.limits = {k: v[chosen] for k, v in LIMITS.items()} | self.limits


FINDING_SCHEMA = (
    "rule_id STRING, category STRING, subject STRING, title STRING, description STRING, severity STRING, confidence STRING, "
    "file STRING, line INT, related_files ARRAY<STRING>, "
    "evidence ARRAY<STRUCT<from_file: STRING, to_file: STRING, file: STRING, line: INT, column: INT, end_line: INT, detail: STRING>>, "
    "recommendation STRING"
)
DIAGNOSTIC_SCHEMA = "code STRING, severity STRING, message STRING, file STRING, line INT, column INT"
DEPENDENCY_SCHEMA = (
    "from_file STRING, line INT, column INT, specifier STRING, kind STRING, syntax STRING, resolution STRING, to_file STRING, reason STRING"
)
