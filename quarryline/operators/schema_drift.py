"""Schemas that drift between files of JSON records: changes of each file, and one table of all records.

Records are profiled per file and field (types, counts, value sketches). A field that went and one that came are
the same quantity under another name if the records which both files carry say so, or, where there are none, if
names and sketches agree; a maximum-weight bipartite matching settles which goes with which.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.snapshot_diff import with_predecessor
from quarryline.session import cut

#: A pair of fields needs at least this weight to be matched.
LEAST_WEIGHT = 0.5
#: Values shorter than this carry too little to identify a quantity without a similar name.
TELLING = 3

FLAT = "producer string, file_name string, row bigint, rec string, field string, kind string, canon string, num double, whole boolean"
#: A table of more columns than this is none: objects keyed by ids, say, have to be unnested first.
MOST_COLUMNS = 10_000
#: Integers beyond this are no longer exact as doubles.
EXACT = 1 << 53


def _no_constant(name: str) -> float:
    raise ValueError(name)


def strict_json(text: str | None) -> object:
    """The value of a JSON text; ValueError for anything that is not strict JSON, null and NaN included."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def flatten(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """The dotted path and value of everything in an object that is neither an object nor null."""
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for name, x in node.items():
            path = f"{at}.{name}" if at else str(name)
            if isinstance(x, dict):
                stack.append((path, x))
            elif x is not None:
                yield path, x


def json_kind(x: object) -> str:
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "number"
    return "array" if isinstance(x, list) else "string"


ISO = re.compile(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d{1,6})?\d*(Z|[+-]\d\d:?\d\d)?$")


def millis(text: str) -> int | None:
    """Epoch milliseconds of an ISO time (UTC where it names no zone)."""
    if not (m := ISO.match(text)):
        return None
    zone = (m[4] or "Z").replace("Z", "+00:00")
    try:
        t = datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}")
    except ValueError:
        return None
    return int(t.astimezone(timezone.utc).timestamp() * 1000) + int(float(m[3] or 0) * 1000)


def canonical(x: object) -> str:
    """The value as text, alike for the same quantity written as number, text, flag, list or time."""
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, int):
        return repr(float(x)) if abs(x) <= EXACT else str(x)
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, list):
        return ",".join(canonical(y) if not isinstance(y, (dict, type(None))) else json.dumps(y, sort_keys=True) for y in x)
    text = x.strip()
    if (low := text.lower()) in ("true", "yes"):
        return "1.0"
    if low in ("false", "no"):
        return "0.0"
    if (t := millis(text)) is not None:
        return repr(float(t))
    try:
        if INTEGER.fullmatch(text):
            return canonical(int(text))
        return repr(float(text)) if text and text[0] in "+-.0123456789" else text
    except ValueError:
        return text


INTEGER = re.compile(r"[+-]?[0-9]{1,4000}")


def whole(canon: str) -> bool | None:
    """Whether a canonical value is an integer of 64 bits, exactly; None if it is no number."""
    try:
        if INTEGER.fullmatch(canon):
            return -(1 << 63) <= int(canon) < 1 << 63
        x = float(canon)
    except ValueError:
        return None
    return x.is_integer() and abs(x) <= EXACT


def flat_records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(producer, file_name, row, payload) to FLAT; a payload that is no valid JSON or no object gives nothing."""
    for part in parts:
        out = []
        for producer, file_name, row, payload in part.itertuples(index=False):
            try:
                value = strict_json(payload)
            except ValueError:
                continue
            if not isinstance(value, dict):
                continue
            run, own = value.get("runId"), value.get("id")
            rec = json.dumps([run, own]) if run is not None and own is not None else None
            for field, x in flatten(value):
                canon = canonical(x)
                if canon in ("0", "1"):
                    canon += ".0"
                try:
                    num = float(canon)
                except ValueError:
                    num = None
                out.append((producer, file_name, row, rec, field, json_kind(x), canon, num, whole(canon)))
        yield pd.DataFrame(out, columns=["producer", "file_name", "row", "rec", "field", "kind", "canon", "num", "whole"])


def words(field: str) -> list[str]:
    """The words of a dotted path, split at case changes, dots and underscores; fillers left out."""
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", field).lower()
    found = re.findall(r"[a-z0-9]+", parts)
    return [w for w in found if w not in ("has", "is", "the")] or found


def _alike(a: str, b: str) -> float:
    if a == b or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a) or a.rstrip("s").startswith(b.rstrip("s")))):
        return 1.0
    return 0.0


def name_similarity(a: str, b: str) -> float:
    """0 to 1: shared words of the paths (a prefix counts as the word), with a little for the letters alone."""
    one, two = words(a), words(b)
    leaf_a, leaf_b = words(a.rpartition(".")[2]), words(b.rpartition(".")[2])
    def share(x: list[str], y: list[str]) -> float:
        hits = sum(max(_alike(w, v) for v in y) for w in x) + sum(max(_alike(w, v) for v in x) for w in y)
        return hits / (len(x) + len(y))
    letters = SequenceMatcher(None, "".join(one), "".join(two), autojunk=False).ratio()
    return 0.45 * share(one, two) + 0.35 * max(share(leaf_a, leaf_b), share(leaf_a, two), share(one, leaf_b)) + 0.2 * letters


def sketch_similarity(a: dict, b: dict) -> float:
    """0 to 1: how far types, numeric ranges and text lengths of two profiles agree."""
    kinds_a, kinds_b = set(a["kinds"]), set(b["kinds"])
    score = 0.4 * len(kinds_a & kinds_b) / len(kinds_a | kinds_b)
    if a["num_share"] > 0.5 and b["num_share"] > 0.5:
        qa, qb = list(a["quantiles"]), list(b["quantiles"])
        low, high = min(qa[0], qb[0]), max(qa[-1], qb[-1])
        apart = sum(abs(x - y) for x, y in zip(qa, qb, strict=True)) / len(qa)
        return score + 0.6 * (1.0 if high == low else max(0.0, 1 - 2 * apart / (high - low)))
    if a["num_share"] <= 0.5 and b["num_share"] <= 0.5:
        return score + 0.6 * min(a["len"], b["len"]) / max(a["len"], b["len"], 1)
    return score


def pair_weight(old: dict, new: dict, same: int, compared: int, telling: bool) -> float:
    """The weight for one field having become another; 0 if it can't have.

    ``same`` of ``compared`` records that both files carry have equal values in the two fields; ``telling`` says
    that the equal values are more than a flag or a digit.
    """
    name = name_similarity(old["field"], new["field"])
    if compared:
        if same / compared < 0.6 or (not telling and name < 0.3):
            return 0.0
        return same / compared + name + 0.3 * telling
    sketch = sketch_similarity(old, new)
    return name + 0.4 * sketch if name >= 0.4 and sketch >= 0.5 else 0.0


def best_matching(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-weight bipartite matching, by shortest augmenting paths."""
    if not weights or not weights[0]:
        return []
    n, m = len(weights), max(len(weights), len(weights[0]))
    cost = [[-w for w in row] + [0.0] * (m - len(row)) for row in weights]
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted(
        (owner[j] - 1, j - 1) for j in range(1, len(weights[0]) + 1) if owner[j] and weights[owner[j] - 1][j - 1] > 0
    )


CHANGES = "producer string, file_name string, change_kind string, old_field string, new_field string"


def _label(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Changes of one file: unmatched columns that went and came, and those that were matched."""
    rows = part.to_dict("records")
    gone = sorted((r for r in rows if r["side"] == "gone"), key=lambda r: r["field"])
    came = sorted((r for r in rows if r["side"] == "came"), key=lambda r: r["field"])
    seen = {(r["field"], r["other"]): r for r in rows if r["side"] == "pair"}
    grid = []
    for old in gone:
        row = []
        for new in came:
            p = seen.get((old["field"], new["field"]))
            w = pair_weight(old, new, p["same"], p["n"], p["len"] >= TELLING) if p else pair_weight(old, new, 0, 0, False)
            row.append(w if w >= LEAST_WEIGHT else 0.0)
        grid.append(row)
    pairs = best_matching(grid)
    out = [("renamed", gone[i]["field"], came[j]["field"]) for i, j in pairs]
    out += [("removed", r["field"], "") for k, r in enumerate(gone) if k not in {i for i, _ in pairs}]
    out += [("added", "", r["field"]) for k, r in enumerate(came) if k not in {j for _, j in pairs}]
    return pd.DataFrame([(*key, *x) for x in out], columns=["producer", "file_name", "change_kind", "old_field", "new_field"])


def flatten_records(records: DataFrame) -> DataFrame:
    """FLAT of (producer, file_name, payload), written once; ``row`` tells the rows of ``records`` apart."""
    numbered = records.select("producer", "file_name", F.monotonically_increasing_id().alias("row"), "payload")
    return cut(numbered.mapInPandas(flat_records, FLAT))


def schema_changes(records: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """(producer, file_name, change_kind, old_field, new_field) of each file against the one before.

    ``records`` has (producer, file_name, file_seq, payload), one row per line. Files of a producer are ordered
    by file_seq, then name; rows without producer, name or number belong to no place in that order and are left
    out. A file whose payloads are all invalid still counts as present, with no fields. Repeated rows change
    nothing. Other columns are not read. Empty tables give no rows. ``flat`` is flatten_records' result for the
    same records, where that is at hand.
    """
    raw = records.where("producer is not null and file_name is not null and file_seq is not null")
    files = raw.select(F.col("producer").alias("series"), F.col("file_name").alias("snap_id"), F.col("file_seq").alias("seq")).distinct()
    steps = cut(
        with_predecessor(files).where("prev_id is not null")
        .select(F.col("series").alias("producer"), F.col("snap_id").alias("file_name"), F.col("prev_id").alias("prev_name"))
    )
    flat = flatten_records(raw) if flat is None else flat.where("producer is not null and file_name is not null")
    size = F.length("canon")
    profile = cut(
        flat.groupBy("producer", "file_name", "field").agg(
            F.array_sort(F.collect_set("kind")).alias("kinds"),
            (F.count("num") / F.count("*")).alias("num_share"),
            F.percentile_approx("num", [0.0, 0.25, 0.5, 0.75, 1.0], 200).alias("quantiles"),
            F.avg(size).alias("len"),
        )
    )
    old = steps.join(profile.withColumnRenamed("file_name", "prev_name"), ["producer", "prev_name"]).drop("prev_name")
    new = steps.select("producer", "file_name").join(profile, ["producer", "file_name"])
    key = ["producer", "file_name", "field"]
    gone = cut(old.join(new.select(*key), key, "left_anti"))
    came = cut(new.join(old.select(*key), key, "left_anti"))
    types = old.withColumnRenamed("kinds", "old_kinds").join(new.select(*key, "kinds"), key).where("old_kinds <> kinds")
    types = types.select("producer", "file_name", F.lit("type_changed").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))

    # records that both files carry, reduced to the fields that went or came before they meet
    known = flat.where("rec is not null").select("producer", "file_name", "rec", "field", "canon").distinct()
    before = known.withColumnRenamed("file_name", "prev_name").join(steps, ["producer", "prev_name"])
    before = before.join(gone.select(*key), key, "left_semi").select("producer", "file_name", "rec", "field", F.col("canon").alias("old_canon"))
    after = known.join(came.select(*key), key, "left_semi").withColumnRenamed("field", "other")
    met = before.join(after, ["producer", "file_name", "rec"])
    equal = F.col("old_canon") == F.col("canon")
    pairs = met.groupBy("producer", "file_name", "field", "other").agg(
        F.count("*").alias("n"), F.count(F.when(equal, 1)).alias("same"), F.max(F.when(equal, size - F.when(F.col("canon").endswith(".0"), 2).otherwise(0))).alias("len")
    )
    none = {"kinds": "array<string>", "num_share": "double", "quantiles": "array<double>", "other": "string", "n": "bigint", "same": "bigint"}
    void = lambda *names: [F.lit(None).cast(none[n]).alias(n) for n in names]
    wide = [
        d.select("producer", "file_name", F.lit(side).alias("side"), "field", "kinds", "num_share", "quantiles", F.col("len").cast("double").alias("len"), *void("other", "n", "same"))
        for d, side in ((gone, "gone"), (came, "came"))
    ]
    linked = pairs.select("producer", "file_name", F.lit("pair").alias("side"), "field", *void("kinds", "num_share", "quantiles"), F.coalesce("len", F.lit(0)).cast("double").alias("len"), "other", "n", "same")
    # a group holds the changed columns of one file, never its records
    sides = wide[0].unionByName(wide[1]).unionByName(linked)
    moved = sides.groupBy("producer", "file_name").applyInPandas(_label, CHANGES)
    return moved.unionByName(types)


def _unified_names(renames: dict[tuple[str, str], int], uses: dict[str, int]) -> dict[str, str]:
    """Each field's name in the one table: of names joined by renames, the one that most files use."""
    root = {f: f for f in uses}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for old, new in sorted(renames, key=lambda p: (-renames[p], p)):
        a, b = find(old), find(new)
        if a != b:
            keep, go = sorted((a, b), key=lambda x: (-uses.get(x, 0), x))
            root[go] = keep
    return {f: find(f) for f in uses}


def column_names(fields: list[str], taken: list[str]) -> dict[str, str]:
    """A column name per field: dots become ``__``; a name that is taken, case aside, gets the next free number."""
    used, out = {t.lower() for t in taken}, {}
    for f in sorted(fields):
        plain = name = f.replace(".", "__")
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{plain}_{n}"
        used.add(name.lower())
        out[f] = name
    return out


def _collected(rows: DataFrame) -> list:
    got = rows.limit(MOST_COLUMNS + 1).collect()
    if len(got) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} fields")
    return got


def unified_records(records: DataFrame) -> DataFrame:
    """One row per row of ``records`` (rec_id, producer, file_name, file_seq, line_no, payload) in one schema.

    Columns of fields joined by renames are one column, named as most files name it (``column_names``) and typed as
    most of its values are: number as bigint if all of them are integers and else double, boolean, array as
    array<string>, else string. Where a producer has two such fields in one record, they are no two names of one
    quantity there: in all its records each keeps its own name. Values of another type than the column's are
    converted (texts of numbers, flags as 0/1/yes/no, lists written with commas). What can't be without loss, a
    second value of one dotted path, and a payload that is JSON but no object (under the empty name) are kept as JSON in
    ``unfitted``, by dotted path, so that every value of a valid payload is in its row. ``valid`` is false for
    payloads that are no valid JSON; their columns are null. The driver sees one row per distinct field name, rename
    and name kept apart, at most MOST_COLUMNS of each, and refuses wider data; never records. Payloads are parsed
    twice: for what is in them, and into their columns.
    """
    flat = flatten_records(records)
    changes = schema_changes(records, flat)
    uses = {r["field"]: r["n"] for r in _collected(flat.groupBy("field").agg(F.countDistinct("producer", "file_name").alias("n")))}
    renames = {(r["old_field"], r["new_field"]): r["count"] for r in _collected(changes.where("change_kind = 'renamed'").groupBy("old_field", "new_field").count())}
    to = _unified_names(renames, uses)
    joined = [(f, t) for f, t in to.items() if any(f in p or t in p for p in renames)]
    apart: set[tuple[str | None, str]] = set()
    if joined:
        of = F.broadcast(records.sparkSession.createDataFrame(joined, "field string, target string"))  # at most MOST_COLUMNS rows
        seen = flat.join(of, "field").groupBy("producer", "row", "target").agg(F.collect_set("field").alias("fields"))
        both = seen.where(F.size("fields") > 1).select("producer", "target").distinct()
        apart = {(r["producer"], r["target"]) for r in _collected(both)}
    kinds: dict[str, dict[str, int]] = {}
    exact: dict[str, bool] = {}
    # producers matter only where they keep names apart
    apart_of = F.col("producer").isin([p for p, _ in apart if p is not None]) if apart else F.lit(False)
    counted = flat.groupBy(F.when(apart_of, F.col("producer")).alias("producer"), "field", "kind").agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole"))
    for r in _collected(counted):
        name = r["field"] if (r["producer"], to[r["field"]]) in apart else to[r["field"]]
        mine = kinds.setdefault(name, {})
        mine[r["kind"]] = mine.get(r["kind"], 0) + r["n"]
        exact[name] = exact.get(name, True) and r["whole"] is not False
    typed = {f: max(sorted(v), key=lambda k: v[k]) for f, v in kinds.items()}
    typed = {f: "integer" if k == "number" and exact[f] else k for f, k in typed.items()}

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            valid, values, unfitted = [], [], []
            for producer, payload in zip(part["producer"], part.pop("payload"), strict=True):
                row: dict[str, str] = {}
                rest: dict[str, list] = {}
                try:
                    value, ok = strict_json(payload), True
                except ValueError:
                    value, ok = {}, False
                if not isinstance(value, dict):
                    rest[""] = [value]
                    value = {}
                producer = None if pd.isna(producer) else producer
                for field, x in flatten(value):
                    name = field if (producer, to[field]) in apart else to[field]
                    got = as_kind(x, typed[name])
                    if got is None or name in row:
                        rest.setdefault(field, []).append(x)
                    else:
                        row[name] = got
                valid.append(ok)
                values.append(row)
                unfitted.append({f: json.dumps(v[0] if len(v) == 1 else v) for f, v in rest.items()} or None)
            yield part.assign(valid=valid, values=values, unfitted=unfitted)

    base = ["rec_id", "producer", "file_name", "file_seq", "line_no"]
    schema = ", ".join(f"{n} {t}" for n, t in records.select(*base).dtypes) + ", valid boolean, values map<string,string>, unfitted map<string,string>"
    rows = records.select(*base, "payload").mapInPandas(convert, schema)
    sql = {"number": "double", "integer": "bigint", "boolean": "boolean", "string": "string"}
    columns = []
    for f, name in column_names(list(typed), [*base, "valid", "unfitted"]).items():
        x = F.try_element_at("values", F.lit(f))
        columns.append((F.from_json(x, "array<string>") if typed[f] == "array" else x.cast(sql[typed[f]])).alias(name))
    return rows.select(*base, "valid", "unfitted", *columns)


def as_kind(x: object, kind: str) -> str | None:
    """The value as text of the wanted kind; None if it can't be that without loss."""
    if kind in ("integer", "number"):
        canon = canonical(x)
        canon = {"0": "0.0", "1": "1.0"}.get(canon, canon)
        try:
            if kind == "integer":
                return str(int(canon) if INTEGER.fullmatch(canon) else int(float(canon))) if whole(canon) else None
            got = float(canon)
        except ValueError:
            return None
        exact = not INTEGER.fullmatch(canon) or int(got) == int(canon)
        return repr(got) if exact and abs(got) != float("inf") else None
    if kind == "boolean":
        return {"1": "true", "1.0": "true", "0": "false", "0.0": "false"}.get(canonical(x))
    if kind == "array":
        if isinstance(x, list):
            return json.dumps([y if isinstance(y, str) else json.dumps(y) for y in x])
        return json.dumps([y for y in x.split(",") if y]) if isinstance(x, str) else None
    return x if isinstance(x, str) else json.dumps(x)
