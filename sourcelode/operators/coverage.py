"""Coverage of categories: complete, partial or unavailable, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CATEGORIES


def status(available: Column, limited: Column) -> Column:
    return F.when(~available, "unavailable").when(limited, "partial").otherwise("complete")


def categories(*, syntax_files: int, text_files: int, entries: int, manifests: int, early_diagnostics: bool, any_diagnostics: bool, uncertain: bool, unknown_packages: bool, duplication_complete: bool, components_truncated: bool, aborted: bool) -> dict[str, tuple[str, str | None]]:
    """The five states of a scan, in the order in which later facts override earlier ones."""
    if aborted:
        return {c: ("unavailable", "The analysis stopped before this category.") for c in CATEGORIES}
    base = ("partial", "Diagnostics limit what was acquired.") if early_diagnostics else ("complete", None)
    out: dict[str, tuple[str, str | None]] = dict.fromkeys(CATEGORIES, base)
    if components_truncated:
        out["cycles"] = ("partial", "More components than the limit of findings.")
    if not entries:
        out["unusedFiles"] = ("unavailable", "No entry point is known; a lack of references proves nothing.")
    else:
        out["unusedFiles"] = ("partial", "Dynamic loading, failures or unresolved entry points may reach more files.") if uncertain else ("complete", None)
    if not manifests:
        out["packages"] = ("unavailable", "No manifest in scope.")
    else:
        out["packages"] = ("partial", "References, manifests or scripts leave usage open.") if uncertain or unknown_packages else ("complete", None)
    if not duplication_complete:
        out["duplication"] = ("partial", "A limit of the duplicate search was reached.")
    if text_files:
        only = "Structure is read from TypeScript and JavaScript alone."
        for c in ("cycles", "unusedFiles", "packages"):
            out[c] = ("partial", only) if syntax_files else ("unavailable", only)
        out["size"] = ("partial", "Text files have line counts, not functions.")
        out["duplication"] = ("partial", "Text files are compared whole.")
    if any_diagnostics:
        out = {c: ("partial", "Acquisition is not complete.") if s == "complete" else (s, r) for c, (s, r) in out.items()}
    return out
