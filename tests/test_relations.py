"""Binned interval joins, islands over ranges, percentiles by selection and Poisson replicates against plain forms."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opalspan.operators import bloom, intervals, lsh_index, merge, prep, quantiles, rules, scoring


def spans(spark, seed, docs=4, n=120, reach=400):
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(n * (5 if d == 0 else 1)):
            s = r.randrange(reach)
            rows.append((d, i, s, s + r.choice([0, 1, 3, 7, 150]), r.choice("XY"), r.choice(["validator", "llm"]), None))
    return rows, spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, label string, source string, score double")


@pytest.mark.parametrize("size", [1, 16, 1024])
def test_overlapping(spark, size):
    a, left = spans(spark, 1, n=30)
    b, right = spans(spark, 2, n=30)
    got = sorted((r["doc_id"], r["a"]["ord"], r["b"]["ord"]) for r in intervals.overlapping(left, right, size=size).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    few = right.where("ord % 9 = 0")
    got = sorted((r["doc_id"], r["ord"]) for r in intervals.missed(left, few, size=size).collect())
    assert got == sorted((x[0], x[1]) for x in a if not any(x[0] == y[0] and y[1] % 9 == 0 and x[2] < y[3] and y[2] < x[3] for y in b))
    assert intervals.overlapping(left.limit(0), right).collect() == []


@pytest.mark.parametrize("reach", [60, 400, 20_000])
def test_union(spark, reach):
    _, df = spans(spark, 3, reach=reach)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(intervals.union(df).drop("score").collect()) == key(merge.union_relation(df).drop("score").collect())


def test_one_large_document(spark):
    """A million spans of one document: spread over tasks, and as many pairs as the rule gives."""
    a = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 2).cast("int").alias("end"))
    b = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 3 + 2).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"))
    pairs = intervals.overlapping(a, b)
    assert pairs.count() == 999_999  # each of b reaches into the next of a
    tasks = pairs.groupBy(F.spark_partition_id()).count().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("few,buckets", [(10_000, 1024), (5, 4), (1, 2), (50, 1024)])
def test_percentiles(spark, few, buckets):
    r = random.Random(few)
    rows = [("hot", r.gauss(0, 1) ** 3) for _ in range(3000)] + [("same", 4.5)] * 200 + [("two", 1.0), ("two", 2.0), ("one", -3.0), (None, 1e308), (None, -1e308), (None, 5.0), ("none", None), ("hot", float("nan")), ("hot", float("inf"))]
    rows += [("ties", float(r.randrange(4))) for _ in range(500)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {(x["g"], x["share"]): x["value"] for x in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, few, buckets).collect()}
    want = {}
    for g in {g for g, _ in rows} - {"none"}:
        own = np.sort([v for k, v in rows if k == g and v is not None and np.isfinite(v)])
        for q in shares:
            at = q * (len(own) - 1)
            low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
            want[g, q] = low + (high - low) * (at - np.floor(at))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)
    whole = quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").where("g = 'hot'"), [], "v", [0.5], few, buckets).collect()
    assert [x["value"] for x in whole] == [pytest.approx(want["hot", 0.5])]


def test_poisson_replicates(spark):
    r = random.Random(6)
    rows = [(d, r.choice(["a", "a", "b", None]), r.randint(0, 30), r.randint(0, 9), r.randint(1, 30), r.randint(0, 9), r.randint(0, 1)) for d in range(300)]
    df = spark.createDataFrame(rows, "doc long, lang string, gold_chars long, leaked_chars long, pred_chars long, over_chars long, leaks long")
    got = {(x["set"], x["metric"]): (x["point"], x["lo"], x["hi"]) for x in scoring.poisson_bootstrap(df, "doc", "lang", 40, 7).collect()}

    def draws(doc, rep):
        u = int(hashlib.md5(f"7|{doc}|{rep // 8}".encode()).hexdigest()[4 * (rep % 8) :][:4], 16)
        return sum(u >= t for t in scoring.DRAWS)

    for lang in "ab":
        own = [x for x in rows if x[1] == lang]
        leak = [sum(x[3] * draws(x[0], k) for x in own) / sum(x[2] * draws(x[0], k) for x in own) for k in range(40)]
        assert got[lang, "leak"] == pytest.approx((sum(x[3] for x in own) / sum(x[2] for x in own), *np.percentile(leak, [2.5, 97.5])), abs=2e-6)
    every = [draws(d, k) for d in range(300) for k in range(40)]
    assert abs(np.mean(every) - 1) < 0.03 and abs(np.var(every) - 1) < 0.05 and None not in {s for s, _ in got}


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_contaminated_behind_a_filter(spark, most):
    """The same keys however full the filter is, and nothing of the set is held back."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    known = [(k, " ".join(r.choices(words, k=20))) for k in range(30)] + [(90, None), (91, "too short")]
    docs = [(k, " ".join(r.choices(words, k=30))) for k in range(120)] + [(500 + k, " ".join(r.choices(words, k=5)) + " " + known[k][1][: 60 - k] + " x") for k in range(30)] + [(900, None), (901, "")]
    grams = lambda t, n: {tuple((t or "").split()[i : i + n]) for i in range(len((t or "").split()) - n + 1)}
    for n in (2, 4, 8):
        every = set().union(*(grams(t, n) for _, t in known))
        got = {x["doc_id"] for x in bloom.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "item_id long, text string"), n, most=most).collect()}
        assert got == {d for d, t in docs if grams(t, n) & every} and got
    none = spark.createDataFrame([], "item_id long, text string")
    assert bloom.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none, 8, most=most).collect() == []


def test_filter_lets_little_through(spark):
    one = bloom.built(spark.range(10_000).select(F.xxhash64("id").alias("h")), "h")
    held = spark.range(110_000).crossJoin(F.broadcast(one)).withColumn("hit", bloom.may_hold(F.col("_bloom"), F.xxhash64("id"))).groupBy((F.col("id") < 10_000).alias("known")).agg(F.avg(F.col("hit").cast("int")).alias("share"))
    share = {x["known"]: x["share"] for x in held.collect()}
    assert share[True] == 1.0 and share[False] < 0.02


def test_predictions_of_another_table(spark):
    kind = "array<struct<start:int,end:int,label:string,text:string,source:string,score:double>>"
    one = lambda s, e, source="m": (s, e, "CITY", "x", source, None)
    examples = spark.createDataFrame([(1, "a" * 20, [one(0, 5)]), (2, "b" * 20, [one(3, 9)]), (3, "c" * 20, []), (None, "d" * 9, [one(0, 4)])], f"id long, text string, spans {kind}")
    given = spark.createDataFrame([(1, [one(0, 5)]), (1, [one(0, 5), one(7, 9)]), (3, [one(1, 2)]), (4, [one(0, 9)]), (None, [one(0, 4)]), (2, [])], f"id long, spans {kind}")
    got = {x["id"]: (x["gold_chars"], x["leaked_chars"], x["pred_chars"], x["n_pred"]) for x in scoring.scored_predictions(examples, given).collect()}
    assert got == {1: (5, 0, 7, 2), 2: (6, 6, 0, 0), 3: (0, 0, 1, 1), None: (4, 4, 0, 0)}


def test_cleaned_and_bad_examples(spark):
    kind = "array<struct<start:int,end:int,label:string,text:string,source:string,score:double>>"
    rows = [(k, "aged 45 percent" if k % 3 == 0 else "he is 45", [(5, 7, "AGE", "45", "g", None)] if k % 3 == 0 else [(6, 8, "AGE", "45", "g", None)]) for k in range(50)]
    kept, report = rules.cleaned(spark.createDataFrame(rows, f"doc_id long, text string, spans {kind}"), ["doc_id"], (5, 1000))
    assert {x["name"]: x["n"] for x in report.collect()} == {"pool": 50, "kept": 33, "dropped": 17, "rule age_not_a_person": 17, "first 5": 5, "first 1000": 33}
    assert [(x["doc_id"], x["rank"]) for x in kept.orderBy("rank").limit(3).collect()] == [(1, 1), (2, 2), (4, 3)]
    bad = spark.createDataFrame([(k, ["a", "b", "c", "d"][: k % 5]) for k in range(30)], "id long, errors array<string>")
    assert [tuple(x) for x in prep.bad_examples(bad, "id").collect()] == [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "b", "c"]), (6, ["a"])]


def test_kept_index(spark, tmp_path):
    """An index filled in two batches finds what the exact join finds; adding again adds no set; recall is measured."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    index = lsh_index.Index(spark, "kept_index_test", str(tmp_path / "index"))
    try:
        index.add(docs.where("id % 3 = 0"))
        before = spark.table("kept_index_test_bands").count()
        index.add(docs.where("id % 3 = 1"))
        index.add(docs.where("id % 3 = 0").withColumn("id", F.col("id") + 100_000))
        assert spark.table("kept_index_test_bands").count() > before
        classes = spark.table("kept_index_test_sets")
        assert classes.count() == classes.select("c").distinct().count() and spark.table("kept_index_test_bands").count() == lsh_index.BANDS * classes.count()
        got = {(r["id"], r["other"]): round(r["jaccard"], 6) for r in index.near(docs.where("id % 3 = 2")).collect()}
        want = {(r["id"], r["other"]): round(r["jaccard"], 6) for r in prep.near_duplicates(docs.where("id % 3 = 2"), docs.where("id % 3 < 2"), 0.8).collect()}
        assert len(want) > 10 and len(got.keys() & want.keys()) / len(want) >= 0.9 and not got.keys() - want.keys()
        assert all(got[k] == want[k] for k in got)
        plan = index.near(docs.where("id % 3 = 2"))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
    finally:
        index.drop()


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        same, n = r.integers(-(2**63), 2**63 - 1, 4000), int(4000 * (1 - share) / (2 * share))
        a, b = (np.concatenate([same, r.integers(-(2**63), 2**63 - 1, n)]) for _ in range(2))
        got = (lsh_index.signature(a) == lsh_index.signature(b)).mean()
        assert abs(got - len(same) / (len(same) + 2 * n)) < 0.15, (share, got)
    assert (lsh_index.signature(np.zeros(0, np.int64)) == np.iinfo(np.uint64).max).all()
