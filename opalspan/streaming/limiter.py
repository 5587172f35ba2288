"""The admitting limiter as a stream: windows kept by visitor, the daily cap by day."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from opalspan.operators.limiter import ADMITTED, DAILY, DAY, WINDOW, admit

_ROW = "who string, day long, at timestamp, tie long, verdict string"


class Windows(StatefulProcessor):
    """Of each visitor the times of the requests that the window let through, `limit` at most."""

    def __init__(self, window: int, limit: int) -> None:
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getValueState("hits", StructType([StructField("at", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        hits = deque(self.hits.get()[0] if self.hits.exists() else [])
        for r in sorted(rows, key=lambda r: (r["micros"], r["tie"])):
            good = admit(hits, r["micros"], self.window, self.limit)
            yield Row(who=key[0], day=r["micros"] // DAY, at=r["at"], tie=r["tie"], verdict=ADMITTED if good else WINDOW)
        self.hits.update((list(hits),))

    def close(self) -> None:
        pass


class Caps(StatefulProcessor):
    """Of each day how many requests were admitted."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", StructType([StructField("n", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for r in sorted(rows, key=lambda r: (r["at"], r["tie"])):
            verdict = DAILY if n >= self.cap else r["verdict"]
            n += verdict == ADMITTED
            yield Row(who=r["who"], day=key[0], at=r["at"], tie=r["tie"], verdict=verdict)
        self.count.update((n,))

    def close(self) -> None:
        pass


def limiter_admission_stream(events: DataFrame, visitor: str, at: str, tie: str, window: int = 60, limit: int = 10, cap: int = 300, late: str = "1 minute") -> DataFrame:
    """events -> (who, day, at, tie, verdict), as operators.limiter gives them, for requests that come in order of time from
    batch to batch; in a batch they may come in any.

    A day's count is one state: a day's requests are counted in one task, with nothing but their times. A request that the
    cap denies has been let through its visitor's window already; so in the first `window` seconds after a day that the cap
    ended a visitor may wait where the batch form lets it pass. A null visitor is one visitor; rows without a time are left
    out, and so are those later than the watermark.
    """
    rows = events.where(F.col(at).isNotNull()).select(F.coalesce(F.col(visitor).cast("string"), F.lit("\0")).alias("who"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("tie"))
    let = rows.withWatermark("at", late).groupBy("who").transformWithState(statefulProcessor=Windows(window * 1_000_000, limit), outputStructType=_ROW, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
    return let.groupBy("day").transformWithState(statefulProcessor=Caps(cap), outputStructType=_ROW, outputMode="Append", timeMode="EventTime")
