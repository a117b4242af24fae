"""Column functions on text: identity, tokens, matching, ranking arithmetic. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "a about all an and any are as at be by can code codex does for from get how i in into is it make of on or project safe safely should system"
    " that the this to update use what when where why with work works"
).split()

#: A query term and the terms that it is expanded by.
SYNONYMS = {
    "api": "route router endpoint handler server app",
    "architecture": "module indexer parser resolver query mcp graph workflow artifact",
    "project": "adapter package manifest node workflow queue run",
    "automatic": "init session hook config mcp",
    "backend": "api route server python adapter store",
    "brief": "task context pack query",
    "caller": "call usage import reference",
    "change": "impact diff risk",
    "dependency": "import edge graph resolver",
    "frontend": "tsx react component hook web",
    "graph": "edge dependency call import reference workflow",
    "mcp": "server tool resource prompt stdio",
    "parser": "tree sitter symbol import usage",
    "polling": "poll run queue status hook",
    "queue": "polling run status dashboard",
    "route": "api handler router endpoint",
    "session": "init hook focus config",
    "test": "pytest vitest spec fixture coverage",
    "workflow": "route job flow execution process adapter store",
}

#: An intent and the words that show it, in the order in which they are reported.
INTENTS = {
    "architecture": r"\b(architecture|understand|overview|map|module|subsystem|competitor|sourcegraph|aider|deepwiki)\b",
    "workflow": r"\b(workflow|flow|execution|route|endpoint|job|process|queue|polling)\b|\b(?:workflow|dependency|call|execution)\s+path\b",
    "debugging": r"\b(debug|bug|fix|error|failure|broken|trace|root cause)\b",
    "testing": r"\b(test|verify|validation|pytest|vitest|coverage|regression)\b",
    "frontend": r"\b(frontend|react|tsx|component|hook|ui|canvas|web)\b",
    "backend": r"\b(backend|api|python|server|adapter|store|database|route)\b",
    "configuration": r"\b(config|env|service|script|deploy|package|manifest|init|hook|session)\b",
    "risk": r"\b(risk|security|shell|filesystem|sql|danger|unsafe|blast)\b",
    "implementation": r"\b(add|implement|change|update|refactor|rename|delete|modify)\b",
}
MOST_TERMS = 40


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that identify the parts; null parts are left out."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 16)


def spaced(value: Column) -> Column:
    """A text in lower case, with blanks where camel case changes."""
    return F.lower(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"))


def tokenize(value: Column) -> Column:
    """The sorted distinct terms of a text: of two or more of a-z and 0-9, without stop words; null gives none."""
    parts = F.split(spaced(F.coalesce(value, F.lit(""))), "[^a-z0-9]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_sort(F.array_except(F.filter(parts, lambda t: F.length(t) >= 2), stop))


def expanded_terms(value: Column) -> Column:
    """A query's terms and their synonyms, sorted; the first 40 of them."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))
    own = tokenize(value)
    more = F.flatten(F.transform(own, lambda t: F.coalesce(table[t], F.array().cast("array<string>"))))
    return F.slice(F.array_sort(F.array_distinct(F.concat(own, more))), 1, MOST_TERMS)


def intents(query: Column, terms: Column) -> Column:
    """The intents that a query and its expanded terms show, in their fixed order; ``unknown`` alone if none."""
    joined = F.concat_ws(" ", F.lower(F.coalesce(query, F.lit(""))), F.array_join(terms, " "))
    found = F.array_compact(F.array(*(F.when(joined.rlike(p), F.lit(n)) for n, p in INTENTS.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def matchable(value: Column) -> Column:
    """A text reduced to its lower-case words, with single blanks."""
    return F.trim(F.regexp_replace(spaced(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def match_score(query: Column, terms: Column, value: Column) -> Column:
    """How well a value matches a query with its expanded terms: 14 equal, 10 contained, else by shared terms up to
    9, else by parts of terms up to 6."""
    q, v = matchable(query), matchable(value)
    hits = F.size(F.array_intersect(terms, tokenize(value)))
    partial = F.size(F.filter(terms, lambda t: (F.length(t) >= 4) & F.contains(v, t)))
    return (
        F.when((q == "") | (v == ""), 0.0)
        .when(v == q, 14.0)
        .when(F.contains(v, q), 10.0)
        .when(hits > 0, F.least(F.lit(9.0), hits * 2.0 + F.when(hits == F.size(terms), 2.0).otherwise(0.0)))
        .otherwise(F.least(F.lit(6.0), partial * 1.5))
    )


def rank_log2(rank: Column) -> Column:
    """log2(rank + 1), with null, NaN, infinite and negative ranks as 0."""
    sane = F.when(F.isnan(rank) | (F.abs(rank) == float("inf")), 0.0).otherwise(F.coalesce(rank, F.lit(0.0)))
    return F.log2(F.greatest(sane, F.lit(0.0)) + 1)


def bm25_idf(docs: Column, df: Column) -> Column:
    """A term's weight in BM25 scores."""
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25_term(docs: Column, df: Column, tf: Column, length: Column, avg_length: Column, k1: float = 1.2, b: float = 0.72) -> Column:
    """One term's part of a document's BM25 score."""
    return bm25_idf(docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_length))


def slug(value: Column) -> Column:
    """A name for files and clusters: lower case, other runs as one hyphen, at most 80 characters."""
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9._/-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "/+", "/"), "^-+|-+$", ""), 1, 80)


def limit_text(value: Column, most: int = 2000) -> Column:
    """A text of at most ``most`` characters, the end of a longer one replaced by a note."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 20), F.lit("\n... truncated ...")))


def redacted(value: Column) -> Column:
    """A text with the values of secrets (tokens, keys, passwords, bearer headers) replaced."""
    named = F.regexp_replace(value, r"(?i)((?:api[_-]?key|token|secret|password|passwd|authorization)\s*[=:]\s*)(?:bearer\s+)?[^\s\"',;]+", "$1[redacted]")
    return F.regexp_replace(named, r"(?i)\bbearer\s+[a-z0-9._~+/-]+=*", "Bearer [redacted]")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def raw_search_terms(text: Column, most: int = 6) -> Column:
    """The longest ``most`` terms of 3 or more characters to search a text's subject literally, each once."""
    longest = F.array_sort(
        F.filter(F.split(text, "[^A-Za-z0-9_.@/-]+"), lambda w: F.length(w) >= 3),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    return F.array_distinct(F.slice(longest, 1, most))
