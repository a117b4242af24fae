"""Sinks: publishing a bundle of tables at once, facts as NDJSON, locks."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables into a new folder below ``root`` and then point ``CURRENT`` to it; gives the folder's name.

    Readers see the old bundle or the new one, never a part. If a write fails, the pointer stays as it is.
    """
    name = f"bundle-{uuid.uuid4().hex}"
    try:
        for table, df in tables.items():
            df.write.parquet(f"{root}/{name}/{table}")
    except Exception:
        shutil.rmtree(f"{root}/{name}", ignore_errors=True)
        raise
    pointer = Path(root, "CURRENT")
    before = pointer.read_text().split("\n") if pointer.exists() else []
    fresh = Path(root, f".current-{uuid.uuid4().hex}")
    fresh.write_text("\n".join([name, *before[:2]]))
    os.replace(fresh, pointer)
    return name


def recover(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table of the newest bundle that can be read."""
    for name in Path(root, "CURRENT").read_text().split("\n"):
        try:
            return spark.read.parquet(f"{root}/{name}/{table}")
        except Exception:  # noqa: BLE001, S112
            continue
    raise FileNotFoundError(f"no readable bundle below {root}")


def write_ndjson(facts: DataFrame, path: str) -> None:
    """Facts as lines of JSON, in parts."""
    facts.write.mode("overwrite").json(path)


@contextmanager
def lock(path: str, stale: float = 120.0, wait: float = 30.0) -> Iterator[None]:
    """Hold a lock file; one not touched for ``stale`` seconds is taken over; TimeoutError after ``wait`` seconds."""
    me, until = uuid.uuid4().hex, time.time() + wait
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(handle, json.dumps({"owner": me}).encode())
            os.close(handle)
            break
        except FileExistsError:
            try:
                if time.time() - os.stat(path).st_mtime > stale:
                    os.unlink(path)
                    continue
            except FileNotFoundError:
                continue
            if time.time() > until:
                raise TimeoutError(path) from None
            time.sleep(0.05)
    try:
        yield
    finally:
        Path(path).unlink(missing_ok=True)


def fit_packet(packet: dict, most_bytes: int = 96_000, keep: int = 3) -> dict:
    """A packet whose JSON has at most ``most_bytes``: its longest lists are halved, down to ``keep`` entries, and what
    was left out is noted under ``truncation``; if that isn't enough, long texts are cut, and last the lists go."""
    out = json.loads(json.dumps(packet, default=str))
    cuts: dict[str, dict[str, int]] = {}

    def size() -> int:
        return len(json.dumps(out | {"truncation": cuts}).encode())

    def lists(node: object, path: str = "") -> Iterator[tuple[int, str, list]]:
        if isinstance(node, dict):
            for k, v in node.items():
                yield from lists(v, f"{path}.{k}" if path else k)
        elif isinstance(node, list):
            yield len(json.dumps(node)), path, node

    while size() > most_bytes:
        long = [(n, p, x) for n, p, x in lists(out) if len(x) > keep]
        if not long:
            break
        _, path, items = max(long, key=lambda t: (t[0], t[1]))
        cuts.setdefault(path, {"total": len(items), "returned": len(items)})
        del items[max(keep, len(items) // 2) :]
        cuts[path]["returned"] = len(items)
    if size() > most_bytes:
        for k, v in out.items():
            if isinstance(v, str) and len(v) > 500:
                out[k] = v[:480] + "... truncated ..."
    if size() > most_bytes:
        out = {k: v for k, v in out.items() if not isinstance(v, (list, dict))}
    return out | ({"truncation": cuts} if cuts else {})


def save_snapshot(folder: str, task_id: str, snapshot: dict) -> str:
    """Write a task's snapshot as JSON, all or nothing; gives its path."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    name = "".join(c if c.isalnum() or c in "-_" else "_" for c in task_id)[:120]
    path, fresh = Path(folder, f"{name}.json"), Path(folder, f".{uuid.uuid4().hex}")
    fresh.write_text(json.dumps({"task_id": task_id, **snapshot}, sort_keys=True, default=str))
    os.replace(fresh, path)
    return str(path)


def load_snapshot(folder: str, task_id: str | None = None) -> dict | None:
    """The snapshot of a task, or the newest one; None if there is none that can be read."""
    files = sorted(Path(folder).glob("*.json"), key=lambda p: p.stat().st_mtime, reverse=True) if Path(folder).is_dir() else []
    for p in files:
        try:
            got = json.loads(p.read_text())
        except ValueError:
            continue
        if task_id is None or got.get("task_id") == task_id:
            return got
    return None
