"""Column functions that score and shape searches over paths, names and tasks. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.paths import DECOY_PART, DECOY_WORD, is_generated, is_test

#: Words of a task that are no code.
PLAIN_WORDS = (
    "add and project change choose codex current debug diff dirty edit fix focused make safe safely test the this update verify verification"
).split()
#: Words of a task that make a hyphenated term the name of a package.
PACKAGE_HINT = r"\b(package|dependency|dependencies|import|module|npm|pnpm|yarn|bun|plugin|config|library|lib|cli|command)\b"
#: What paths of stores, adapters and manifests, store-like names, job decorators, documents and
#: configuration look like, and a task that asks for copies.
STORE_PATH = r"(?i)(^|/)(store|stores|repository|repositories|db|database|models|execution|queue|run-store)(/|\.|$)"
ADAPTER_PATH = r"(?i)(^|/)adapters?/|(^|/).*adapter.*\.(py|[cm]?[jt]sx?)$"
MANIFEST_PATH = r"(?i)(^|/)(packages?|manifests?)/"
STORE_NAME = r"\b(RunStore|Store|Repository|Coordinator|Database)\b|(Store|Repository|Coordinator)$"
JOB_DECORATOR = r"(?i)(task|job|worker|celery|rq)"
DOCUMENT_PATH = r"\.(md|mdx|rst|txt)$|^docs/"
CONFIG_PATH = r"\.(json|toml|ya?ml|ini|service|env|cfg)$|(^|/)(Dockerfile|docker-compose|package|tsconfig|vite\.config|vitest\.config|pyproject|requirements)|^scripts/[^/]+\.sh$"
ASKS_FOR_COPIES = r"(?i)\b(decoy|mock|fixture|backup|old|copy)\b"


def plain(value: Column) -> Column:
    """A text without blanks around it, in lower case; null as empty."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def _copy_like(text: Column) -> Column:
    return F.regexp_replace(text, "[_-]", " ").rlike(DECOY_WORD) | F.regexp_replace(text, "[^a-z0-9]+", "").rlike(DECOY_PART)


def search_terms(query: Column) -> Column:
    """A query as a whole, its terms of two or more characters, and the parts of those that look like paths."""
    q = F.coalesce(query, F.lit(""))
    terms = F.filter(F.transform(F.split(q, "[^A-Za-z0-9_./@-]+"), plain), lambda t: F.length(t) >= 2)
    parts = F.flatten(F.transform(F.filter(terms, lambda t: t.rlike("[/.@]")), lambda t: F.filter(F.split(t, "[./@-]+"), lambda p: F.length(p) >= 2)))
    return F.array_distinct(F.concat(F.array(plain(q)), terms, parts))


def search_score(query: Column, value: Column) -> Column:
    """How well a value matches a search: 10 it is a term, 9 its stem is one, 6 one of its words is, 2 it contains one,
    else 0. What looks like a copy, mock or fixture scores under 9 only where the query asks for such."""
    v = plain(value)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "/+$", ""), "^.*/", ""), r"\.[^.]+$", "")
    words = F.split(v, "[^a-z0-9]+")
    each = F.transform(
        F.filter(search_terms(query), lambda t: t != ""),
        lambda t: F.when(v == t, 10).when(stem == t, 9).when(F.array_contains(words, t), 6).when(F.contains(v, t), 2).otherwise(0),
    )
    best = F.coalesce(F.array_max(each), F.lit(0))
    q = plain(query)
    return F.when((q == "") | (v == ""), 0).when(_copy_like(v) & ~_copy_like(q) & (best < 9), 0).otherwise(best)


def search_reason(score: Column) -> Column:
    """exact, stem, token, substring or miss."""
    return F.when(score >= 10, "exact").when(score >= 9, "stem").when(score >= 6, "token").when(score > 0, "substring").otherwise("miss")


def code_query(task: Column) -> Column:
    """The terms of a task that look like code, each once, sorted; the first four of them, with blanks between."""
    text = F.coalesce(task, F.lit(""))
    terms = F.transform(F.split(text, "[^A-Za-z0-9_./@:-]+"), lambda t: F.regexp_replace(t, r"^[./@:-]+|[./@:-]+$", ""))
    package = F.lower(text).rlike(PACKAGE_HINT)
    kept = F.filter(
        terms,
        lambda t: (F.length(t) >= 3)
        & ~F.lower(t).isin(*PLAIN_WORDS)
        & (t.rlike("[._/@:]") | (F.contains(t, F.lit("-")) & package) | t.rlike("[a-z][A-Z]") | t.rlike(r"[A-Z].*\d|\d.*[A-Z]") | t.rlike("^[A-Z0-9]{3,}$")),
    )
    return F.array_join(F.slice(F.array_sort(F.array_distinct(kept)), 1, 4), " ")


def intent_boost(intents: Column, path: Column, test: Column, dirty: Column, risk: Column) -> Column:
    """What a file gains by the intents of a task."""
    def when(intent: str, what: Column, gain: Column | float) -> Column:
        return F.when(F.array_contains(intents, intent) & F.coalesce(what, F.lit(False)), gain).otherwise(0.0)

    changing = F.array_contains(intents, "implementation") | F.array_contains(intents, "debugging")
    return (
        when("frontend", path.startswith("web/") | path.rlike(r"\.(tsx|jsx)$"), 2.5)
        + when("backend", path.endswith(".py") | F.contains(path, F.lit("_api/")) | F.contains(path, F.lit("/adapters/")), 2.5)
        + when("testing", test, 3.0)
        + when("configuration", path.rlike(r"\.(json|toml|ya?ml|service|sh)$"), 2.0)
        + when("architecture", path.rlike(r"src/(indexer|parser|resolver|queries|mcp|artifacts|eval|init)\.ts$"), 4.0)
        + when("workflow", path.rlike(r"(?i)(app|route|adapter|store|execution|queue|polling|workflow|run)"), 3.0)
        + when("risk", risk > 0, F.least(F.lit(4.0), risk / 4))
        + F.when(F.coalesce(dirty, F.lit(False)) & changing, 1.5).otherwise(0.0)
    )


def impact_kind(path: Column, known: Column) -> Column:
    """generated, test, docs, config, source (a known file) or unknown."""
    return (
        F.when(path.startswith(".codex/") | is_generated(path), "generated").when(is_test(path), "test").when(path.rlike(DOCUMENT_PATH), "docs")
        .when(path.rlike(CONFIG_PATH), "config").when(known, "source").otherwise("unknown")
    )


def asks_for_copies(query: Column) -> Column:
    """Whether a query speaks of decoys, mocks, fixtures, backups, old ones or copies."""
    return F.coalesce(query, F.lit("")).rlike(ASKS_FOR_COPIES)


def is_store_path(path: Column) -> Column:
    return path.rlike(STORE_PATH)


def is_adapter_path(path: Column) -> Column:
    return path.rlike(ADAPTER_PATH)


def is_manifest_path(path: Column) -> Column:
    return path.rlike(MANIFEST_PATH) & F.lower(path).endswith(".json")


def is_store_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(STORE_NAME)


def is_job_decorator(text: Column) -> Column:
    return text.rlike(JOB_DECORATOR)
