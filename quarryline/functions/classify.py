"""Ordered first-match classifications, predicates and path keys, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that classify.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
EXCLUDED = ("node_modules", ".git", "venv", "dist", "build", "__pycache__")
SOURCE_ROOTS = ("src", "lib", "app", "pkg", "packages")
SEVERITY_LEVEL = {"HIGH": "error", "CRITICAL": "error", "MEDIUM": "warning", "LOW": "note"}


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no outer blanks, no leading dots and slashes, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), "^[./]+", ""), "/+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def name_prefix(name: Column) -> Column:
    """What stands before the first ``_`` or ``-``, else the first four letters of a long name, else all of it."""
    return (
        F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1))
        .when(F.contains(name, F.lit("-")), F.substring_index(name, "-", 1))
        .when(F.length(name) >= 6, F.substring(name, 1, 4))
        .otherwise(name)
    )


def language_of(path: Column) -> Column:
    return first_match([(F.endswith(path, F.lit(ext)), lang) for ext, lang in LANGUAGES.items()], "unknown")


def is_pruned(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in EXCLUDED)))


def is_test(path: Column) -> Column:
    return (path.rlike(r"(^|/)tests?/") | base_name(path).rlike(r"^test_|_test\.")) & ~F.contains(path, F.lit("fixtures/"))


def sarif_level(severity: Column) -> Column:
    return first_match([(severity == k, v) for k, v in SEVERITY_LEVEL.items()], "note")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "LOW", 2).otherwise(3)


def has_traversal(path: Column) -> Column:
    return path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"[;&|`$<>]")


def is_fix_words(subject: Column) -> Column:
    """A fix by whole words."""
    return F.lower(subject).rlike(r"\b(fix|bug|hotfix|revert)\b")


def is_fix_contains(subject: Column) -> Column:
    """A fix by any occurrence, unless the subject is about documents."""
    s = F.lower(subject)
    return s.rlike("fix|bug|issue|hotfix|patch") & ~s.rlike("docs|readme|typo")


def escape_annotation(text: Column) -> Column:
    """Percent-escape what would end an annotation line."""
    for old, new in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fingerprint(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, length)
