"""Sliding-window rate limiter in event time: rejected events don't count against later ones."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(times: list[int], limit: int, window: int, held: list[int]) -> tuple[list[bool], list[int], list[int]]:
    """For ascending times in microseconds: allowed or not, seconds to wait, and the allowed times still in the window."""
    held, allowed, wait = list(held), [], []
    for t in times:
        while held and held[0] <= t - window:
            held.pop(0)
        allowed.append(len(held) < limit)
        wait.append(0 if allowed[-1] else max(1, ceil(((held[0] if held else t) + window - t) / 1e6)))
        if allowed[-1]:
            held.append(t)
    return allowed, wait, held


def limit_events(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: int) -> DataFrame:
    """``key, order, allowed, wait_s`` for every event, by key in time order.

    A pause of a whole window forgets everything, so a key's events are cut there and its parts are dealt out apart. A
    task walks through its sorted rows and holds the window of one part, at most ``limit`` times. Finding the pauses sorts each key's times
    in one task, on disk if need be: a key with a third of all events takes as long as its sort.
    """
    window = window_s * 1_000_000
    own = Window.partitionBy(key).orderBy("t", order)
    rows = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kinds = dict(rows.dtypes)
    rows = rows.withColumn("_cut", (F.col("t") - F.lag("t").over(own) >= window).cast("int")).withColumn("_part", F.sum(F.coalesce("_cut", F.lit(0))).over(own))
    rows = rows.repartition(key, "_part").sortWithinPartitions(key, "_part", "t", order).select(key, order, "t", "_part")

    def run(batches):
        now, held = None, []
        for own in batches:
            keys, times = list(zip(own[key].tolist(), own["_part"].tolist(), strict=True)), own["t"].tolist()
            allowed, wait, at = [], [], 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                a, w, held = decide(times[at:end], limit, window, held if keys[at] == now else [])
                allowed, wait, now, at = allowed + a, wait + w, keys[at], end
            own["allowed"], own["wait_s"] = allowed, wait
            yield own[[key, order, "allowed", "wait_s"]]

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, wait_s long")


def refreshes(seen: DataFrame, key: str, ts: str, order: str, seconds: int = 60) -> DataFrame:
    """The events of a session that renew its last-seen time: the first, and each that comes ``seconds`` or more after the last renewal."""
    return limit_events(seen, key, ts, order, 1, seconds).where("allowed").select(key, order)


def limit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: int, late: str = "1 minute") -> DataFrame:
    """The same for a stream, with the window's times as state; events of a micro-batch are taken in time order.

    Events may be ``late``; a key's state goes once the watermark is a window past its last allowed event.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.withWatermark(ts, late).select(key, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kinds = dict(rows.dtypes)

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches)).sort_values(["t", order])
        held = list(state.get[0]) if state.exists else []
        own["allowed"], own["wait_s"], held = decide(own["t"].tolist(), limit, window_s * 1_000_000, held)
        state.update((held,))
        state.setTimeoutTimestamp(max((held[-1] if held else 0) // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield own[[key, order, "allowed", "wait_s"]]

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, wait_s long"
    return rows.groupBy(key).applyInPandasWithState(run, out, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
