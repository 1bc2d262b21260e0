"""Replays of interaction events: the last event of a burst wins, and what an event does to what is tracked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, event_id, n): the last event and the size of each burst, a burst being events less than a gap apart.

    The same for a static and a streaming table; give a stream a watermark on ts first.
    """
    bursts = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    return bursts.select("user_id", "last.event_id", "n")


def typed_slices(texts: DataFrame, n_slices: int) -> DataFrame:
    """(event_id, z) of typed texts: a whole number, held within the slices; null for anything else."""
    clean = F.trim("typed")
    number = F.when(F.regexp_like(clean, F.lit("^[+-]?[0-9]{1,18}$")), clean.try_cast("bigint"))
    return texts.select("event_id", F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n_slices - 1), number))).cast("int").alias("z"))


Tracked = tuple[int, int, dict[int, int]]


def track(state: Tracked | None, event: dict, f: int) -> tuple[str, Tracked | None]:
    """What an event does to what is tracked: the slice, the label, and the label of each slice of the path."""
    if event["path"] is not None:
        path = {p["z"]: p["label_id"] for p in event["path"]}
        return "tracked", (event["z"], path[event["z"]], path)
    if state is None:
        return "untracked", None
    (z, label, path), at = state, int(event["z_l0"]) // f
    if at == z:
        return "same layer", state
    if at not in path:
        return "out of path", (at, label, path)
    between = range(z + 1, at + 1) if at > z else range(at, z)
    step = "label changed" if path[at] != label else "instance changed" if any(path.get(i) != label for i in between) else "moved"
    return step, (at, path[at], path)
