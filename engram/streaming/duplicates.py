"""Duplicates of a stream of points: the newest of each group of equal texts, kept as state, with what changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import text_hash
from ..operators.audit import rank_key

CHANGES = "group string, id string, keep boolean"
_ENTRY = "rank string, unnumbered boolean, number long, id string"


def _before(a: tuple, b: tuple) -> bool:
    """Whether a is kept rather than b: the later date, then the first in scroll order."""
    return (a[0], *map(_Reverse, a[1:])) > (b[0], *map(_Reverse, b[1:]))


class _Reverse:
    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return self.value == other.value

    def __gt__(self, other):
        return self.value < other.value

    __lt__ = __gt__


class Newest(StatefulProcessor):
    """Keeps one entry and a count for a group, however many points it has, and passes points on as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", f"{_ENTRY}, points long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (group,) = key
        *held, points = self.state.get() if self.state.exists() else (None, 0)
        best = told = tuple(held) if points else None
        told = told if points > 1 else None
        for frame in rows:
            gone = []
            for rank, unnumbered, number, point in zip(*(frame[c] for c in ("rank", "unnumbered", "number", "id")), strict=True):
                entry = (rank, bool(unnumbered), int(number), point)
                points += 1
                if best is None or _before(entry, best):
                    entry, best = best, entry
                if entry is not None and entry[3] != best[3]:
                    gone.append(entry[3])
            if gone:
                yield pd.DataFrame({"group": group, "id": gone, "keep": False})
        if points > 1 and best != told:
            yield pd.DataFrame({"group": [group], "id": [best[3]], "keep": [True]})
        self.state.update((*best, points))

    def close(self) -> None:
        pass


def duplicate_changes(points: DataFrame, by_source: bool = False) -> DataFrame:
    """group, id, keep: for each micro-batch, points of groups of equal texts that are kept, and those that are so no longer
    or never were.

    points is a stream of points. Applied one batch after the other, the changes give what dedupe_ranked gives of all points
    so far: the newest of each group of several, undated ones oldest, ties to the first in scroll order. A point alone in
    its group is no change. State holds one entry for each group; it needs the RocksDB state store.
    """
    group = text_hash(F.col("text"))
    if by_source:
        group = F.md5(F.concat_ws("|", F.col("source"), group))
    # the number stands for itself or for its absence, which comes last
    entry = points.select(group.alias("group"), rank_key().alias("rank"), F.col("id_num").isNull().alias("unnumbered"), F.coalesce("id_num", F.lit(0)).cast("long").alias("number"), "id")
    return entry.groupBy("group").transformWithStateInPandas(Newest(), CHANGES, "Update", "None")
