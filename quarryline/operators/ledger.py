"""Verification ledger: what a shell command really verified, and which required checks that covers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import ancestors

#: Tools and what running them verifies.
TOOLS = {
    "test": r"^(pytest|py\.test|tox|nox|vitest|jest|mocha|ava|tap|karma|playwright|cypress|go test|cargo (test|nextest)|mvn (test|verify)|gradle test|ctest|phpunit|rspec|unittest)\b",
    "typecheck": r"^(tsc|mypy|pyright|flow|pyre|vue-tsc)\b",
    "lint": r"^(eslint|ruff|flake8|pylint|clippy|golangci-lint|shellcheck|stylelint|biome|cargo clippy|go vet)\b",
    "format": r"^(prettier|black|gofmt|rustfmt|cargo fmt|ruff format)\b",
    "build": r"^(make|cmake|webpack|rollup|vite build|esbuild|cargo build|go build|mvn package|gradle build|docker build)\b",
}
RUNNERS = re.compile(r"^(?:npx|pnpm exec|pnpm dlx|yarn dlx|bunx|uv run|poetry run|pipenv run|python3? -m|env|time|nice|command|exec|xvfb-run)\s+")
ASSIGNMENT = re.compile(r"^[A-Za-z_]\w*=(?:'[^']*'|\"[^\"]*\"|\S*)\s+")
NOT_RUNNING = re.compile(r"(?:^|\s)(?:--help|-h|--version|-V|--list|--collect-only|--listTests|--dry-run|--passWithNoTests|--noEmit=false|--showConfig)(?:\s|$)")
SCRIPT = re.compile(r"^(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?([\w:.-]+)(?:\s|$)")
OPENERS = re.compile(r"^(?:if|while|until|case|for|select|function|then|else|elif|do|\{|\()\b|^[({]")


def split_shell(command: str) -> list[tuple[str, str]]:
    """(segment, operator that follows it) of a command line: split at && || ; | & and line ends outside quotes, with
    comments and here-documents left out. Raises ValueError where quotes are left open."""
    text = re.sub(r"<<-?\s*(['\"]?)(\w+)\1[^\n]*\n(?:.*\n)*?\s*\2(?=\n|$)", "", command)
    out: list[tuple[str, str]] = []
    part, quote, k = "", "", 0
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\" and quote == '"' and k + 1 < len(text):
                part += text[k : k + 2]
                k += 2
                continue
            quote = "" if c == quote else quote
            part += c
        elif c == "\\" and k + 1 < len(text):
            part += "" if text[k + 1] == "\n" else text[k : k + 2]
            k += 2
            continue
        elif c in "'\"`":
            quote = c
            part += c
        elif c == "#" and (not part or part[-1].isspace()):
            while k < len(text) and text[k] != "\n":
                k += 1
            continue
        elif text[k : k + 2] in ("&&", "||"):
            out.append((part.strip(), text[k : k + 2]))
            part = ""
            k += 2
            continue
        elif c in ";|\n" or (c == "&" and not re.search(r"[<>]$", part) and text[k + 1 : k + 2] != ">"):
            out.append((part.strip(), ";" if c == "\n" else c))
            part = ""
        else:
            part += c
        k += 1
    if quote:
        raise ValueError("open quote")
    out.append((part.strip(), ""))
    return [(s, op) for s, op in out if s]


@dataclass
class Coverage:
    kind: str
    target: str
    trusted: bool
    reason: str


def analyse(command: str, scripts: dict[str, str] | None = None, seen: frozenset[str] = frozenset()) -> list[Coverage]:
    """What a command verifies if it ends with 0; nothing is credited whose failure that exit would hide.

    A segment's exit is hidden by a later ``||`` or ``;`` or a pipe behind it (without pipefail), by ``&`` in the
    background, and inside any compound command or substitution. Package scripts are followed, once each.
    """
    try:
        parts = split_shell(command)
    except ValueError:
        return [Coverage("unknown", "", False, "open quote")]
    strict = any(re.match(r"set\s+-\w*e", s) for s, _ in parts)
    pipefail = any("pipefail" in s for s, _ in parts)
    compound = any(OPENERS.match(s) for s, _ in parts)
    out: list[Coverage] = []
    for k, (segment, operator) in enumerate(parts):
        hidden = ""
        later = [op for _, op in parts[k:-1]] if parts else []
        if operator == "&":
            hidden = "runs in the background"
        elif operator == "|" and not pipefail:
            hidden = "a pipe hides its exit"
        elif "||" in later:
            hidden = "an alternative hides its exit"
        elif ";" in later and not strict:
            hidden = "a later command sets the exit"
        elif k and parts[k - 1][1] == "||":
            hidden = "runs only if another fails"
        elif compound:
            hidden = "stands in a compound command"
        elif segment.startswith("! "):
            hidden = "its exit is inverted"
        words = segment
        while m := ASSIGNMENT.match(words) or RUNNERS.match(words):
            words = words[m.end() :]
        if NOT_RUNNING.search(words):
            out.append(Coverage("none", "", False, "doesn't run anything"))
            continue
        if m := SCRIPT.match(words):
            name = m[1]
            body = (scripts or {}).get(name)
            if body is not None and name not in seen:
                out += [Coverage(c.kind, c.target, c.trusted and not hidden, hidden or c.reason) for c in analyse(body, scripts, seen | {name})]
                continue
            if body is not None:
                out.append(Coverage("unknown", name, False, "a script that calls itself"))
                continue
        for kind, pattern in TOOLS.items():
            if re.match(pattern, words):
                if kind == "typecheck" and re.search(r"--(?:showConfig|init|listFiles(?:Only)?)\b", words):
                    out.append(Coverage("none", "", False, "doesn't compile"))
                    break
                targets = [w for w in words.split()[1:] if not w.startswith("-") and ("/" in w or re.search(r"\.\w+$", w))]
                out += [Coverage(kind, t, not hidden, hidden) for t in targets or [""]]
                break
    return out


COVERED = "row_id string, kind string, target string, trusted boolean, reason string"


def coverage(reports: DataFrame, scripts: dict[str, str] | None = None) -> DataFrame:
    """COVERED of command reports (row_id, command, exit_code, cwd): a missing exit code or working directory, or an
    exit other than 0, makes a coverage unknown."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row_id, command, code, cwd in part[["row_id", "command", "exit_code", "cwd"]].itertuples(index=False):
                ok = code == code and code is not None and int(code) == 0 and isinstance(cwd, str)
                for c in analyse(command or "", scripts):
                    rows.append((row_id, c.kind if ok else "unknown", c.target, bool(c.trusted and ok), c.reason if ok else "exit or place unknown or failed"))
            yield pd.DataFrame(rows, columns=["row_id", "kind", "target", "trusted", "reason"])

    return reports.mapInPandas(run, COVERED)


def ledger(checks: DataFrame, covered: DataFrame, waivers: DataFrame) -> DataFrame:
    """Required checks (check_id, kind, path) as ``covered``, ``waived`` or ``missing``.

    A trusted coverage of the kind counts if it has no target, is the path, or is a folder above it. Folders are
    looked up by equality with the path's ancestors.
    """
    good = covered.where("trusted").select("kind", F.regexp_replace("target", "/$", "").alias("at")).distinct().withColumn("hit", F.lit(True))
    places = F.array_distinct(F.concat(F.array("path"), ancestors(F.col("path")), F.array(F.lit(""))))
    tried = checks.select("check_id", "kind", F.explode(places).alias("at")).join(good, ["kind", "at"]).select("check_id").distinct().withColumn("_covered", F.lit(True))
    waived = waivers.select("check_id").distinct().withColumn("_waived", F.lit(True))
    out = checks.join(tried, "check_id", "left").join(waived, "check_id", "left")
    state = F.when(F.col("_covered"), "covered").when(F.col("_waived"), "waived").otherwise("missing")
    return out.select(*checks.columns, state.alias("state"))


def command_plan(candidates: DataFrame) -> DataFrame:
    """Commands (command, kind, target, source) with all their kinds, targets and sources, as sorted text."""
    def joined(c: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return candidates.groupBy("command").agg(joined("kind"), joined("target"), joined("source"), F.count("*").alias("n"))
