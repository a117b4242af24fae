"""Evaluation of retrieval against expected files, and a seeded generator of repositories with decoys."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(found: Column, expected: Column) -> Column:
    """The part of the expected that was found; 1 if nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, found)) / F.size(F.array_distinct(expected)))


def precision(found: Column, expected: Column) -> Column:
    """The part of the found that is expected; of nothing found 1 if nothing is expected, else 0."""
    right = F.size(F.filter(found, lambda x: F.array_contains(expected, x)))
    return F.when(F.size(found) == 0, F.when(F.size(expected) == 0, 1.0).otherwise(0.0)).otherwise(right / F.size(found))


def score_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios (scenario, found, expected, tests_found, tests_expected, baseline, forbidden, min_recall) with
    recall, precision at k, test recall, failures and score.

    k is the number expected. A scenario fails by too little recall, by each forbidden file that was found, and if
    the baseline finds more or as much with better precision. The score is the mean of the measures less a tenth per
    failure, half at most, and not below 0.
    """
    f, e, b = F.col("found"), F.col("expected"), F.col("baseline")
    k = F.greatest(F.size(e), F.lit(1))
    s = scenarios.withColumns({
        "recall": recall(f, e), "precision": precision(F.slice(f, F.lit(1), k), e), "test_recall": recall(F.col("tests_found"), F.col("tests_expected")),
        "base_recall": recall(b, e), "base_precision": precision(F.slice(b, F.lit(1), k), e), "broken": F.size(F.array_intersect(f, F.col("forbidden"))),
    })
    better = (F.col("base_recall") > F.col("recall")) | ((F.col("base_recall") >= F.col("recall")) & (F.col("base_precision") > F.col("precision")))
    failures = (F.col("recall") < F.coalesce("min_recall", F.lit(1.0))).cast("int") + F.col("broken") + better.cast("int")
    s = s.withColumn("baseline_better", better).withColumn("failures", failures)
    mean = (F.col("recall") + F.col("precision") + F.when(F.size("tests_expected") > 0, F.col("test_recall")).otherwise(F.lit(0.0))) / F.when(F.size("tests_expected") > 0, 3).otherwise(2)
    score = F.greatest(F.lit(0.0), mean - F.least(F.lit(0.5), F.col("failures") * 0.1))
    return s.select("scenario", "recall", "precision", "test_recall", "baseline_better", "failures", score.alias("score"))


def suite(scored: DataFrame) -> DataFrame:
    """The mean score of a suite, and whether all of it passed."""
    return scored.agg(F.avg("score").alias("score"), F.every(F.col("failures") == 0).alias("passed"), F.count("*").alias("scenarios"))


def synthetic_repository(seed: int) -> dict[str, str]:
    """Path -> text of a small repository whose names depend on the seed, with a decoy for each real file."""
    rng = random.Random(seed)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    title = word.capitalize()
    return {
        f"src/{word}/store.ts": f"export class {title}Store {{\n  load(id: string) {{ return id; }}\n}}\n",
        f"src/{word}/api.ts": f'import {{ {title}Store }} from "./store";\nexport function load{title}() {{ return new {title}Store().load("a"); }}\n',
        f"src/{word}/api.test.ts": f'import {{ load{title} }} from "./api";\ntest("{word}", () => load{title}());\n',
        f"src/{word}_decoy/api.ts": f"export function load{title}Old() {{ return null; }}\n",
        f"{word}_api/jobs.py": f"def run_{word}(value):\n    return value\n",
        f"tests/test_{word}_jobs.py": f"from {word}_api.jobs import run_{word}\n\n\ndef test_{word}():\n    assert run_{word}(1) == 1\n",
    }
