"""Uploads that were begun and never finished, found by timers on the state of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BEGUN, FINISHED = 0, 1


class Uploads(StatefulProcessor):
    """Per item, whether its upload is still open and since when; a timer ends it."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", StructType([StructField("state", IntegerType()), StructField("since", LongType())]))

    def wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        state, since = self.item.get() if self.item.exists() else (BEGUN, None)
        for batch in rows:
            for status, ms in zip(batch["status"], batch["ms"], strict=True):
                state = FINISHED if status != "UPLOADING" else state
                since = int(ms) if since is None else min(since, int(ms))
        # a finished item is remembered as long as an earlier event of it may still come
        self.item.update((state, since))
        self.wake(max(since + self.wait + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"item_id": pd.Series([], dtype="object"), "created_at": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        state, since = self.item.get()
        self.item.clear()
        if state == BEGUN:
            yield pd.DataFrame({"item_id": [key[0]], "created_at": [pd.Timestamp(since, unit="ms")]})

    def close(self) -> None:
        pass


def abandoned_stream(items: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """``item_id, created_at`` of each item whose upload began and did not end within ``minutes``, once.

    ``items``: a stream of ``item_id, status, at``; the first event of an item begins its upload, any status but UPLOADING ends it. Time is
    the watermark's, so a restart or a slow batch changes nothing; events may be ``late``. The state store must be RocksDB's.
    """
    rows = items.withWatermark("at", late).select("item_id", "status", "at", F.unix_millis("at").alias("ms"))
    kind = dict(rows.dtypes)["item_id"]
    return rows.groupBy("item_id").transformWithStateInPandas(Uploads(minutes), f"item_id {kind}, created_at timestamp", "append", "eventTime")
