"""The limiter against a request-by-request fold, in batch and as a stream; running counts against windows."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opalspan.operators import ordered
from opalspan.operators.limiter import limited

START = datetime(2024, 3, 9, 23, 0, tzinfo=UTC)


def one_by_one(rows, window, limit, cap):
    """(id -> verdict), request by request in order of time and id."""
    hits, day, count, out = defaultdict(deque), None, 0, {}
    for i, visitor, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if at.astimezone(UTC).date() != day:
            day, count = at.astimezone(UTC).date(), 0
        if count >= cap:
            out[i] = "daily"
            continue
        q = hits[visitor]
        while q and at - q[0] > timedelta(seconds=window):
            q.popleft()
        if len(q) >= limit:
            out[i] = "window"
        else:
            q.append(at)
            count += 1
            out[i] = "admitted"
    return out | {i: None for i, _, at in rows if at is None}


def requests(seed, n=900, visitors=5, span=3 * 3600):
    """Over midnight; one visitor has half of them; whole seconds, so that times tie and gaps are exactly the window."""
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < 0.5 else r.choice([f"v{k}" for k in range(visitors)] + [None]), START + timedelta(seconds=r.randrange(span))) for i in range(n)]
    return rows + [(n, "v1", None), (n + 1, None, None)]


@pytest.mark.parametrize("seed,window,limit,cap", [(1, 60, 2, 10_000), (2, 60, 3, 120), (3, 600, 5, 40), (4, 60, 1, 1), (5, 0, 1, 200), (6, 100_000, 50, 90)])
def test_limited(spark, seed, window, limit, cap):
    rows = requests(seed)
    df = spark.createDataFrame(rows, "verdict_id long, who string, at timestamp").repartition(3)
    got = {r["verdict_id"]: r["verdict"] for r in limited(df, "who", "at", "verdict_id", window, limit, cap).collect()}
    want = one_by_one(rows, window, limit, cap)
    assert got == want
    assert len({v for v in want.values() if v}) >= 2


def test_limited_odd_tables(spark):
    schema = "id long, who string, at timestamp, _at string"
    assert limited(spark.createDataFrame([], schema), "who", "at", "id").collect() == []
    twice = [(1, "a", START, "x")] * 3
    got = limited(spark.createDataFrame(twice, schema), "who", "at", "id", 60, 2, 100)
    assert got.columns == ["id", "who", "at", "_at", "verdict"] and sorted(r["verdict"] for r in got.collect()) == ["admitted", "admitted", "window"]
    with pytest.raises(ValueError):
        limited(spark.createDataFrame([], schema), "who", "at", "id", cap=0)


def test_running_counts(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.randint(0, 3)) for k in r.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    w = Window.partitionBy("g").orderBy("k")
    want = {(x["g"], x["k"]): x["n"] for x in df.withColumn("n", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).collect()}
    assert {(x["g"], x["k"]): x["before"] for x in ordered.before(df, ["g"], ["k"], F.col("v")).collect()} == want
    for n in (1, 50, 10_000):
        want = {(x["g"], x["k"]) for x in df.withColumn("n", F.row_number().over(w)).where(F.col("n") == n).collect()}
        assert {(x["g"], x["k"]) for x in ordered.nth(df.where("g is not null"), ["g"], ["k"], n).collect()} == {x for x in want if x[0]}


def test_taken_until_k(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), k, r.choice([True, False, None])) for k in r.sample(range(9000), 600)]
    df = spark.createDataFrame(rows, "g string, k long, good boolean")
    for k in (1, 37, 10_000):
        accepted, dropped, want = defaultdict(int), defaultdict(int), set()
        for g, i, good in sorted(rows, key=lambda x: x[1]):
            if accepted[g] < k:
                accepted[g] += bool(good)
                dropped[g] += not good
                want |= {(g, i)} if good else set()
        got, counts = ordered.taken(df, ["k"], F.col("good"), k, ["g"])
        assert {(x["g"], x["k"]) for x in got.collect()} == want
        assert {x["g"]: (x["accepted"], x["dropped"]) for x in counts.collect()} == {g: (accepted[g], dropped[g]) for g in "ab"}


def test_admission_stream(spark, tmp_path):
    """Batch by batch as request by request; the cap ends a day only where no window reaches over midnight."""
    from opalspan.streaming.limiter import limiter_admission_stream

    rows = [(i, who, at) for i, who, at in requests(7, n=300) if at is not None and not (START + timedelta(seconds=3540) < at < START + timedelta(seconds=3670))]
    rows.sort(key=lambda r: (r[2], r[0]))
    source, schema = str(tmp_path / "in"), "id long, who string, at timestamp"
    for k in range(0, len(rows), 100):
        spark.createDataFrame(random.Random(k).sample(rows[k : k + 100], len(rows[k : k + 100])), schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = limiter_admission_stream(stream, "who", "at", "id", 60, 2, 70, "1 hour").writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["tie"]: r["verdict"] for r in spark.table("admitted").collect()}
    want = one_by_one(rows, 60, 2, 70)
    assert got == want and set(want.values()) == {"admitted", "window", "daily"}


def test_denied_requests_are_skipped(monkeypatch):
    """Of a visitor's 100,000 requests only those that a window lets through, and the first that it denies, are looked at
    one by one; the outcome is that of looking at all."""
    import numpy as np

    from opalspan.operators import limiter

    calls, admit = [], limiter.admit
    monkeypatch.setattr(limiter, "admit", lambda *a: calls.append(1) or admit(*a))
    r = np.random.default_rng(3)
    for times, window, limit in ((100_000, 9_000, 2), (3_000, 2, 3), (3_000, 0, 1), (40, 5, 50)):
        at = np.sort(r.integers(0, times, 100_000 if times == 100_000 else 2_000))
        before = [-1]
        hits = limiter.deque(before)
        want = [i for i, t in enumerate(at.tolist()) if admit(hits, t, window, limit)]
        calls.clear()
        places, left = limiter.admitted(at, before, window, limit)
        assert places.tolist() == want and [h for h in left if times - h <= window] == [h for h in hits if times - h <= window]
        assert len(calls) <= 2 * len(want) + 1
