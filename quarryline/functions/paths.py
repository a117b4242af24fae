"""Column functions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """The path with ``/`` only and no leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def strip_text(value: Column) -> Column:
    """``value`` without white space at either end (of any kind, not only blanks)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


#: Extensions of each language.
LANGUAGES = {
    "typescript": "ts tsx",
    "javascript": "js jsx mjs cjs",
    "python": "py",
    "rust": "rs",
    "go": "go",
    "java": "java",
    "csharp": "cs",
    "cpp": "cc cpp cxx hpp hh hxx",
    "c": "c h",
    "ruby": "rb",
    "php": "php",
    "json": "json",
    "markdown": "md mdx rst txt",
}
#: Directories and file ends that no index reads.
SKIPPED_DIRECTORIES = (
    ".git .hg .svn .codex node_modules dist build coverage .next .nuxt .vite .cache .pytest_cache __pycache__ .venv venv target .mypy_cache .ruff_cache"
).split()
SKIPPED_ENDS = (".min.js", ".map", ".lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
#: What a path of generated source, a test, a public surface and a decoy looks like.
GENERATED = r"(^|[/\\])(generated|__generated__|gen)([/\\]|$)|(^|/)[^/]+(\.generated|\.gen)\.[cm]?[jt]sx?$|(^|/)[^/]+(_pb2|_pb2_grpc)\.py$"
TEST = r"(^|/)(tests?|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|(^|/)[^/]+_test\.py$|(^|/)[^/]+_test\.go$"
PUBLIC = r"(^|/)(app|server|routes|api|router|main|index)\.[cm]?[jt]sx?$|(^|/)(app|server|routes|api|main|__init__)\.py$|/adapters/|/packages/|^scripts/(service|release|preview)-control\.sh$|\.service$"
DECOY_WORD = r"(?:^|\b|[._/-])(decoy|mock|old|backup|copy|fixture)(?:$|\b|[._/-])"
DECOY_PART = r"(decoy|mock|backup|fixture)"


def extension_of(path: Column) -> Column:
    """The extension of a path's last part in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that a path's extension tells, or ``unknown``."""
    ext = extension_of(path)
    return F.coalesce(*(F.when(ext.isin(*e.split()), F.lit(n)) for n, e in LANGUAGES.items()), F.lit("unknown"))


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST)


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(GENERATED)


def is_public(path: Column) -> Column:
    return path.rlike(PUBLIC)


def is_skipped(path: Column) -> Column:
    """Whether a path lies in a directory of build output and the like, or is a lock, map or minified file."""
    inside = F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))
    return inside | F.coalesce(*(F.when(path.endswith(e), True) for e in SKIPPED_ENDS), F.lit(False))


def is_decoy(path: Column) -> Column:
    """Whether a path looks like a copy, mock, fixture or backup."""
    low = F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1 $2"))
    return low.rlike(DECOY_WORD) | F.regexp_replace(low, "[^a-z0-9]+", "").rlike(DECOY_PART)


def module_of(path: Column) -> Column:
    """The module that a path belongs to: its first directory, two under ``web`` and ``*_api``, ``root`` without any."""
    p = F.split(path, "/")
    return (
        F.when(F.size(p) <= 1, F.lit("root"))
        .when((p[0] == "web") & (F.size(p) > 2), F.concat(F.lit("web/"), F.try_element_at(p, F.lit(2))))
        .when(p[0].endswith("_api"), F.concat(p[0], F.lit("/"), F.try_element_at(p, F.lit(2))))
        .otherwise(p[0])
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, down to the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
