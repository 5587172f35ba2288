"""A rate limiter that counts what it admits: a sliding window for each visitor, a daily cap for all together."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opalspan.operators.ordered import PART, nth, parts, ranged
from opalspan.sources.shared import kept

ADMITTED, WINDOW, DAILY = "admitted", "window", "daily"
DAY = 86_400_000_000
_ORDER = ["_at", "_tie", "_row"]


def admit(hits: deque, at: int, window: int, limit: int) -> bool:
    """One request against the visitor's admitted ones, times in microseconds; it is added if it is admitted. A hit of
    exactly `window` before still counts."""
    while hits and at - hits[0] > window:
        hits.popleft()
    if len(hits) >= limit:
        return False
    hits.append(at)
    return True


def admitted(at: np.ndarray, hits: list, window: int, limit: int) -> tuple[np.ndarray, list]:
    """Places of the requests of one visitor, sorted times, that are admitted after `hits`, and the last hits, as `admit`
    one by one would: where no limit + 1 of them lie within the window all are; else what a full window denies is skipped."""
    whole = np.concatenate([np.array(hits, dtype=np.int64), at])
    if len(whole) <= limit or (whole[limit:] - whole[:-limit] > window).all():
        return np.arange(len(at)), whole[-limit:].tolist()
    live, places, i = deque(hits), [], 0
    while i < len(at):
        if admit(live, int(at[i]), window, limit):
            places.append(i)
            i += 1
        else:
            i = int(np.searchsorted(at, live[0] + window, "right"))
    return np.array(places, dtype=np.int64), list(live)


def _over(at: np.ndarray, tie: np.ndarray, row: np.ndarray, last: dict) -> np.ndarray:
    """Which requests come after the last that the cap of their day admits."""
    if not last:
        return np.zeros(len(at), dtype=bool)
    days = np.array(sorted(last))
    place = np.minimum(np.searchsorted(days, at // DAY), len(days) - 1)
    a, t, r = np.array([last[d] for d in days.tolist()], dtype=np.int64).T[:, place]
    return (days[place] == at // DAY) & ((at > a) | (at == a) & ((tie > t) | (tie == t) & (row > r)))


def _fold(starts: dict, last: dict, window: int, limit: int, give: str):
    """Rows sorted by (_part, _who, time): each visitor's requests in order.

    starts: of each part the visitor and hits that the parts before it leave. last: of each day the place of the last
    request that the cap admits. Gives, as `give` says, the rows with their verdicts, the places of admitted rows by day, or
    of each part its first request and what it leaves (ends).
    """
    names = ["_part", "_first_who", "_first_at", "_last_who", "_hits"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, who, hits, first = None, None, [], None
        ends: list[tuple] = []
        words = pa.array([WINDOW, ADMITTED, DAILY])
        for b in batches:
            if not b.num_rows:
                continue
            of = lambda c, b=b: b.column(b.schema.get_field_index(c))
            p, at, tie, row = (of(c).to_numpy() for c in (PART, *_ORDER))
            names_of = of("_who").dictionary_encode()
            w = names_of.indices.to_numpy()
            over = _over(at, tie, row, last)
            said = np.where(over, 2, 0).astype(np.int8)
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (w[1:] != w[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
                own = names_of.dictionary[int(w[i])].as_py()
                if p[i] != part:
                    if part is not None:
                        ends.append((part, *first, who, hits))
                    part, first = int(p[i]), (own, int(at[i]))
                    who, hits = starts.get(part, (None, []))
                if own != who:
                    who, hits = own, []
                free = np.flatnonzero(~over[i:j]) + i
                places, hits = admitted(at[free], hits, window, limit)
                said[free[places]] = 1
            if give == "verdicts":
                yield pa.record_batch([*(b.column(k) for k in range(b.num_columns)), words.take(pa.array(said))], names=[*b.schema.names, "verdict"])
            if give == "admitted":
                good = said == 1
                yield pa.record_batch([pa.array(x[good]) for x in (at // DAY, at, tie, row)], names=["_day", *_ORDER])
        if give == "ends":
            if part is not None:
                ends.append((part, *first, who, hits))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*ends) if ends else [[]] * 5, kinds)], names=names)

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), PART).sortWithinPartitions(PART, "_who", *_ORDER)


def _starts(rows: DataFrame, last: dict, window: int, limit: int, starts: dict) -> dict:
    """Of each part the hits that its first visitor brings along. Parts are folded side by side from what they are thought
    to start with, again until what one leaves is what the next was thought to start with: a visitor's requests may fill
    many parts, and where a gap of the window or the limit itself makes it forget, the first round is right. The first part
    brings nothing along, so one outcome only agrees with itself, whatever `starts` is thought of first."""
    while True:
        # one row a part: its visitor and `limit` times at most
        ends = sorted(map(tuple, _sorted(rows).mapInArrow(_fold(starts, last, window, limit, "ends"), "_part int, _first_who string, _first_at long, _last_who string, _hits array<long>").collect()))
        new = {}
        for (_, _, _, who, hits), (part, first, at, _, _) in zip(ends, ends[1:]):
            live = [h for h in hits if at - h <= window]
            if first == who and live:
                new[part] = (who, live)
        if new == starts:
            return starts
        starts = new


def _capped(hits: DataFrame, cap: int) -> DataFrame:
    """The cap-th of the admitted requests of each day. Counts by the minute, 1,440 a day at most, tell in which minute it
    is, and what comes after that minute is not dealt nor sorted."""
    hits = kept(hits.withColumn("_minute", F.expr(f"pmod(_at, {DAY}) div 60000000")), "hits")
    upto = F.sum("_n").over(Window.partitionBy("_day").orderBy("_minute"))
    counts = hits.groupBy("_day", "_minute").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", upto)
    holds = counts.where((F.col("_upto") >= cap) & (F.col("_upto") - F.col("_n") < cap)).select("_day", F.col("_minute").alias("_until"))
    # a row a day
    near = hits.join(F.broadcast(holds), "_day").where(F.col("_minute") <= F.col("_until"))
    return nth(near.select("_day", *_ORDER), ["_day"], _ORDER, cap)


def limited(events: DataFrame, visitor: str, at: str, tie: str, window: int = 60, limit: int = 10, cap: int = 300) -> DataFrame:
    """events with verdict: admitted, window or daily.

    In order of time, of equal times by `tie`: a request is denied (daily) if `cap` requests of its UTC day, of all
    visitors, are admitted already, else (window) if `limit` of its visitor's were admitted within `window` seconds, both
    ends included; only admitted requests count, and denied ones leave no trace. A null visitor is one visitor, a null time
    has no verdict; equal rows are requests each, in any order. Columns stay.

    Requests are dealt to ranges of (visitor, time), so a visitor with a third of them fills many tasks; what a range
    leaves to the next is found by rounds. A day's cap ends it after its `cap`-th admitted request, found by ranges of
    time; it changes only what follows, so days settle in order, most at once.
    """
    if limit < 1 or cap < 1 or window < 0:
        raise ValueError("limit and cap must be at least 1, the window at least 0")
    names = events.columns
    rows = events.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_event"), F.coalesce(F.col(visitor).cast("string"), F.lit("\0")).alias("_who"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    timed = ranged(rows.where("_at is not null"), "_who", *_ORDER)
    # rounds need no more than who and when
    slim = timed.select(PART, "_who", *_ORDER)
    last: dict = {}
    starts: dict = {}
    micros = window * 1_000_000
    while True:
        starts = _starts(slim, last, micros, limit, starts)
        hits = _sorted(slim).mapInArrow(_fold(starts, last, micros, limit, "admitted"), "_day long, _at long, _tie long, _row long")
        # one row a day that reaches the cap
        new = {r["_day"]: (r["_at"], r["_tie"], r["_row"]) for r in _capped(hits, cap).collect()}
        if new == last:
            break
        last = new
    out = _sorted(timed).mapInArrow(_fold(starts, last, micros, limit, "verdicts"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema) + ", verdict string")
    untimed = rows.where("_at is null").select("_event.*", F.lit(None).cast("string").alias("verdict"))
    return out.select("_event.*", "verdict").unionByName(untimed)

