"""Replacements that were begun and not ended, noted beside what they replace.

Replacing partitions takes two steps, a write and the removal of partitions that
lost all of their rows, and a run takes several tables. A job that dies in
between leaves some of that undone. It has noted what it was about to do, and the
next job on the same table or tables does that first.

Notes are only ever added, so that no two jobs write the same file: one when a
replacement begins, one when it has ended. A table that is replaced whole loses
its notes with everything else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyfare.sources.tables import scan_if_exists

JOURNAL = "_journal"
BEGUN, ENDED = "begun", "ended"

Arguments = Mapping[str, Any]


def _note(spark: SparkSession, root: str, run: str, event: str, arguments: str) -> None:
    note = spark.createDataFrame([(run, event, arguments)], "run string, event string, arguments string")
    note.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/{JOURNAL}")


def begin(spark: SparkSession, root: str, arguments: Arguments) -> str:
    """Note a replacement that is about to start; returns the name under which it ends."""
    run = uuid.uuid4().hex
    _note(spark, root, run, BEGUN, json.dumps(arguments, sort_keys=True))
    return run


def end(spark: SparkSession, root: str, run: str) -> None:
    _note(spark, root, run, ENDED, "")


def pending(spark: SparkSession, root: str) -> list[tuple[str, dict[str, Any]]]:
    """Name and arguments of each replacement that has not ended, in a fixed order."""
    notes = scan_if_exists(spark, f"{root.rstrip('/')}/{JOURNAL}")
    if notes is None:
        return []
    ended = notes.filter(F.col("event") == ENDED).select("run")
    open_ = notes.filter(F.col("event") == BEGUN).join(ended, "run", "left_anti")
    # one row for each job that died since the last one that did not
    return [(r.run, json.loads(r.arguments)) for r in open_.orderBy("arguments", "run").collect()]


@contextmanager
def resumed(
    spark: SparkSession,
    root: str,
    arguments: Arguments,
    replay: Callable[[dict[str, Any]], object],
    untouched: Callable[[], bool] = lambda: False,
) -> Iterator[None]:
    """What earlier jobs left undone first, then the block, noted before and after.

    ``replay`` does what a note says. A note of what the block itself does is
    not replayed: the block ends it. A block that fails stays noted, unless it
    refused its input (ValueError, FileNotFoundError) while all was ``untouched``:
    an input that is refused must not stand in the way of others.
    """
    own = json.loads(json.dumps(arguments))
    same = []
    for run, noted in pending(spark, root):
        if noted == own:
            same.append(run)
        else:
            replay(noted)
            end(spark, root, run)
    fresh = None if same else begin(spark, root, arguments)
    try:
        yield
    except (ValueError, FileNotFoundError):
        if fresh and untouched():
            end(spark, root, fresh)
        raise
    for run in same or [fresh]:
        end(spark, root, run)
