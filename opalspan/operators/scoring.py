"""Detection quality: leakage, over-redaction, precision and recall, resampling, selection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalspan.functions.spans import IGNORE, deduped, let, positions

COUNTS = ("gold_chars", "leaked_chars", "pred_chars", "over_chars", "leaks", "strict_tp", "n_gold", "n_pred", "partial_gold_hit", "partial_pred_hit")
#: Fixed values of model selection: tie band and gains in points, shares that a sound run may drop or cut off.
TIE, RELATIVE_GAIN, NOISE, OVER_GAIN, MAX_DROPPED, MAX_TRUNCATED = 1.0, 0.20, 0.15, 1.5, 0.05, 0.02


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k of n, within [0, 1]; (0, 1) for n = 0."""
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(1.0)


def scored(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """df(text, gold, pred) with the ten counts per document, and by_label.

    Gold spans labelled IGNORE are out of scope: not leaked, masking them is no over-redaction, and predictions wholly
    inside them do not count. Real gold wins where both overlap. A null prediction is none.
    """
    size = F.length("text")
    inside = lambda s: positions(F.array(s.withField("start", F.greatest(F.lit(0), s["start"])).withField("end", F.least(size, s["end"]))))
    own = F.filter(F.col(gold), lambda s: s["label"] != IGNORE)
    a = df.withColumn("_g", deduped(own)).withColumn("_p0", deduped(F.coalesce(F.col(pred), F.array().cast(df.schema[gold].dataType))))
    a = a.withColumn("_gm", positions(F.col("_g")))
    a = a.withColumn("_im", F.array_except(positions(F.filter(F.col(gold), lambda s: s["label"] == IGNORE)), F.col("_gm")))
    a = a.withColumn("_p", F.filter("_p0", lambda s: F.size(F.array_except(inside(s), F.col("_im"))) > 0))
    a = a.withColumn("_pm", F.array_except(F.array_distinct(F.flatten(F.transform("_p", inside))), F.col("_im")))
    key = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["end"], s["label"]))
    touched = lambda spans, by: F.size(F.filter(F.col(spans), lambda s: F.arrays_overlap(positions(F.array(s)), F.col(by))))
    a = a.withColumn("_tp", F.array_intersect(key(F.col("_g")), key(F.col("_p"))))
    missed = lambda s: F.size(F.array_except(positions(F.array(s)), F.col("_pm")))
    def piece(x: Column, lab: Column) -> Column:
        mine = lambda s: s["label"] == lab
        n = lambda spans, test: F.size(F.filter(x[spans], test))
        total = lambda value: F.aggregate(F.transform(F.filter(x["g"], mine), value), F.lit(0), lambda a, b: a + b)
        at = lambda s: positions(F.array(s))
        return F.struct(
            lab.alias("label"),
            n("g", mine).alias("n_gold"),
            total(lambda s: s["end"] - s["start"]).alias("gold_chars"),
            total(lambda s: F.size(F.array_except(at(s), x["pm"]))).alias("leaked_chars"),
            n("g", lambda s: mine(s) & F.arrays_overlap(at(s), x["pm"])).alias("partial_gold_hit"),
            n("tp", mine).alias("strict_tp"),
            n("p", mine).alias("n_pred"),
            n("p", lambda s: mine(s) & F.arrays_overlap(at(s), x["gm"])).alias("partial_pred_hit"),
        )

    sets = F.struct(F.col("_g").alias("g"), F.col("_p").alias("p"), F.col("_gm").alias("gm"), F.col("_pm").alias("pm"), F.col("_tp").alias("tp"))
    labels = lambda x: F.array_union(F.transform(x["g"], lambda s: s["label"]), F.transform(x["p"], lambda s: s["label"]))
    values = {
        "gold_chars": F.size("_gm"),
        "leaked_chars": F.size(F.array_except("_gm", "_pm")),
        "pred_chars": F.size("_pm"),
        "over_chars": F.size(F.array_except("_pm", "_gm")),
        "leaks": F.exists("_g", lambda s: missed(s) > 0).cast("int"),
        "strict_tp": F.size("_tp"),
        "n_gold": F.size("_g"),
        "n_pred": F.size("_p"),
        "partial_gold_hit": touched("_g", "_pm"),
        "partial_pred_hit": touched("_p", "_gm"),
    }
    out = a.select(*df.columns, *[v.cast("long").alias(k) for k, v in values.items()], let(sets, lambda x: F.transform(labels(x), lambda lab: piece(x, lab))).alias("by_label"))
    return out


def scored_predictions(examples: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """examples(key, text, spans, ...) scored against predictions(key, spans): a left join, in which an example without
    predictions predicted nothing. Predictions of a key that stands several times are taken together, equal ones once."""
    whole = predictions.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode("spans").alias("s")).groupBy("_key").agg(F.array_distinct(F.collect_list("s")).alias("_pred"))
    both = examples.join(whole, F.col(key) == F.col("_key"), "left").drop("_key")
    return scored(both.withColumn("_pred", F.coalesce("_pred", F.array().cast(both.schema["_pred"].dataType))), "spans", "_pred").drop("_pred")


def measures() -> list[Column]:
    """Micro-averaged measures over sums of the ten counts."""
    s = {c: F.sum(c) for c in COUNTS}
    p, r = ratio(s["strict_tp"], s["n_pred"], 1.0), ratio(s["strict_tp"], s["n_gold"], 1.0)
    pp, pr = ratio(s["partial_pred_hit"], s["n_pred"], 1.0), ratio(s["partial_gold_hit"], s["n_gold"], 1.0)
    named = {
        "docs": F.count(F.lit(1)),
        "n_gold_spans": s["n_gold"],
        "n_pred_spans": s["n_pred"],
        "leakage_chars": ratio(s["leaked_chars"], s["gold_chars"]),
        "leakage_docs": ratio(s["leaks"], F.count(F.lit(1))),
        "leakage_gold_docs": ratio(s["leaks"], F.sum((F.col("gold_chars") > 0).cast("long"))),
        "over_redaction": ratio(s["over_chars"], s["pred_chars"]),
        "strict_precision": p,
        "strict_recall": r,
        "strict_f1": f1(p, r),
        "partial_precision": pp,
        "partial_recall": pr,
        "partial_f1": f1(pp, pr),
    }
    return [F.round(v, 6).alias(k) if k not in ("docs", "n_gold_spans", "n_pred_spans") else v.alias(k) for k, v in named.items()]


def overall(scores: DataFrame) -> DataFrame:
    return scores.agg(*measures())


def by_group(scores: DataFrame, *keys: str) -> DataFrame:
    """Measures per value of each key, of documents that have it; one pass by grouping sets."""
    long = scores.select(*COUNTS, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("g"))
    return long.where("g.value is not null").groupBy("g.key", "g.value").agg(*measures())


def by_label(scores: DataFrame) -> DataFrame:
    rows = scores.select(F.explode("by_label").alias("b")).select("b.*")
    s = {c: F.sum(c) for c in ("n_gold", "n_pred", "gold_chars", "leaked_chars", "strict_tp", "partial_gold_hit", "partial_pred_hit")}
    p, r = ratio(s["strict_tp"], s["n_pred"], 1.0), ratio(s["strict_tp"], s["n_gold"], 1.0)
    return rows.groupBy("label").agg(s["n_gold"].alias("n_gold"), s["n_pred"].alias("n_pred"), F.round(ratio(s["leaked_chars"], s["gold_chars"]), 6).alias("leakage_chars"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def missed(df: DataFrame, key: str = "doc_id", gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Gold spans, IGNORE apart, that no prediction of their document overlaps."""
    g = df.select(key, F.explode(F.col(gold)).alias("s")).where(F.col("s.label") != IGNORE).select(key, "s.start", "s.end", "s.label")
    p = df.select(F.col(key).alias("_k"), F.explode(F.col(pred)).alias("p")).select("_k", F.col("p.start").alias("_s"), F.col("p.end").alias("_e"))
    return g.join(p, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")


def compare_misses(base: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Misses of two runs: fixed, still missed, new."""
    on = [key, "start", "end"]
    fixed = base.join(other, on, "left_anti").withColumn("status", F.lit("fixed"))
    still = base.join(other, on, "left_semi").withColumn("status", F.lit("still_missed"))
    new = other.join(base, on, "left_anti").withColumn("status", F.lit("new"))
    return fixed.unionByName(still).unionByName(new)


def draw(*parts: Column) -> Column:
    """A 60-bit number from the md5 of its parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _replicates(counts: DataFrame, n: int, seed: int) -> DataFrame:
    """counts(set, pos from 0, ...) resampled with replacement within each set, n times: (set, rep, pos), one row a draw.
    Indices are hashes, so a rerun draws the same. Draws are not counted by document: nearly all are different, so a
    task would hold them all for nothing."""
    sizes = counts.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    # one row a set
    rows = counts.select("set", F.col("pos").alias("slot")).join(F.broadcast(sizes), "set").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("set", "rep", (draw(F.lit(seed), F.col("set"), F.col("rep"), F.col("slot")) % F.col("size")).alias("pos"))


def _drawn(counts: DataFrame, draws: DataFrame) -> DataFrame:
    """draws with the counts of their documents. A task holds its share of the counts and reads its draws as a stream;
    neither side is sorted."""
    return counts.hint("shuffle_hash").join(draws, ["set", "pos"])


_RATIOS = {"leak": ("leaked_chars", "gold_chars"), "over": ("over_chars", "pred_chars"), "doc": ("leaks", "has_gold")}


_SUMMED = ("leaked_chars", "gold_chars", "over_chars", "pred_chars", "leaks", "has_gold")


def _weighted(df: DataFrame, *keys: str) -> DataFrame:
    sums = {c: F.sum(F.col(c) * F.col("draws")) for c in _SUMMED}
    return df.groupBy(*keys).agg(*[ratio(sums[a], sums[b]).alias(k) for k, (a, b) in _RATIOS.items()])


def bootstrap(counts: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """(set, metric, point, lo, hi): 95 % percentile intervals by resampling documents of counts(set, pos, the six
    counts)."""
    points = _weighted(counts.withColumn("draws", F.lit(1)), "set")
    samples = _weighted(_drawn(counts, _replicates(counts, n, seed)).withColumn("draws", F.lit(1)), "set", "rep")
    ends = samples.groupBy("set").agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{k}_ci") for k in _RATIOS])
    both = points.join(ends, "set")
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(k, 6).alias("point"), F.round(F.col(f"{k}_ci")[0], 6).alias("lo"), F.round(F.col(f"{k}_ci")[1], 6).alias("hi")) for k in _RATIOS])
    return both.select("set", F.explode(rows).alias("m")).select("set", "m.*")


#: Of 65,536 equally likely numbers, how many give at most 0, 1, 2, ... draws of a document in a replicate: a Poisson
#: variable of mean 1.
DRAWS = tuple(round(65536 * sum(1 / math.factorial(i) for i in range(k + 1)) / math.e) for k in range(8))


def poisson_draws(doc: Column, n: int, seed: int) -> Column:
    """array<struct<rep, draws>> of a document in n replicates, without those that don't draw it. An md5 of seed, document
    and block gives eight numbers of 16 bits, so other engines draw the same."""
    number = lambda rep: F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), doc.cast("string"), F.floor(rep / 8).cast("string"))), (rep % 8) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    draws = lambda u: sum(((u >= t).cast("int") for t in DRAWS), F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda rep: F.struct(rep.alias("rep"), draws(number(rep)).alias("draws")))
    return F.filter(each, lambda x: x["draws"] > 0)


def poisson_bootstrap(scores: DataFrame, doc: str, group: str, n: int = 2000, seed: int = 0) -> DataFrame:
    """(set, metric, point, lo, hi): 95 % percentile intervals from n replicates in which each document of
    scores(doc, group, counts) comes a Poisson number of times.

    No document needs to know another: a task sums what its documents draw, so only a row for each set and replicate is
    shuffled, and no places are given. A replicate without any document has no ratio and is left out.
    """
    counts = scores.select(F.col(group).alias("set"), F.col(doc).alias("doc"), "gold_chars", "leaked_chars", "pred_chars", "over_chars", (F.col("gold_chars") > 0).cast("int").alias("has_gold"), "leaks").where(F.col("set").isNotNull())
    points = _weighted(counts.withColumn("draws", F.lit(1)), "set")
    drawn = counts.withColumn("x", F.explode(poisson_draws(F.col("doc"), n, seed))).withColumn("rep", F.col("x.rep")).withColumn("draws", F.col("x.draws"))
    # n rows a set at most
    ends = _weighted(drawn, "set", "rep").groupBy("set").agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{k}_ci") for k in _RATIOS])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(k, 6).alias("point"), F.round(F.col(f"{k}_ci")[0], 6).alias("lo"), F.round(F.col(f"{k}_ci")[1], 6).alias("hi")) for k in _RATIOS])
    return points.join(ends, "set").select("set", F.explode(rows).alias("m")).select("set", "m.*")


def paired_bootstrap(a: DataFrame, b: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """Differences a - b over the same resampled documents, averaged over sets: metric, point, lo, hi, a_better. Both
    systems' counts of a document stand in one row, so that its draws are dealt once; a set and replicate without
    documents of b has no difference."""
    named = lambda c, p: c.select("set", "pos", F.struct(*_SUMMED).alias(p))
    both = _drawn(named(a, "a").join(named(b, "b"), ["set", "pos"], "left"), _replicates(a, n, seed))
    sums = both.groupBy("set", "rep").agg(*[F.sum(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in _SUMMED], F.count("b").alias("_n")).where("_n > 0")
    values = sums.select("rep", *[ratio(F.col(f"{p}_{x}"), F.col(f"{p}_{y}")).alias(f"{p}_{k}") for p in "ab" for k, (x, y) in _RATIOS.items()])
    diffs = values.groupBy("rep").agg(*[F.avg(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(k) for k in _RATIOS])
    whole = lambda c: _weighted(c.withColumn("draws", F.lit(1)), "set")
    point = whole(a).alias("x").join(whole(b).alias("y"), "set").agg(*[F.avg(F.col(f"x.{k}") - F.col(f"y.{k}")).alias(f"{k}_point") for k in _RATIOS])
    ends = diffs.agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{k}_ci") for k in _RATIOS], *[F.avg((F.col(k) < 0).cast("double")).alias(f"{k}_share") for k in _RATIOS])
    # both sides are one row of sums
    both = point.crossJoin(ends)
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(f"{k}_point", 6).alias("point"), F.round(F.col(f"{k}_ci")[0], 6).alias("lo"), F.round(F.col(f"{k}_ci")[1], 6).alias("hi"), F.round(f"{k}_share", 6).alias("a_better")) for k in _RATIOS])
    return both.select(F.explode(rows).alias("m")).select("m.*")


def seed_mean(counts: DataFrame) -> DataFrame:
    """counts(seed, set, pos, ...) averaged over seeds."""
    names = [c for c in counts.columns if c not in ("seed", "set", "pos")]
    return counts.groupBy("set", "pos").agg(*[F.avg(c).alias(c) for c in names])


def seed_spread(counts: DataFrame) -> DataFrame:
    """(set, spread): greatest minus least leakage over seeds."""
    per = counts.groupBy("set", "seed").agg(ratio(F.sum("leaked_chars"), F.sum("gold_chars")).alias("leak"))
    return per.groupBy("set").agg((F.max("leak") - F.min("leak")).alias("spread"))


def candidates(results: DataFrame, primary: list[str], in_dist: list[str]) -> DataFrame:
    """results(tag, testset, leakage_chars, over_redaction, items, dropped_items, outputs, truncated) -> one row per
    tag: mean percentages over the primary sets (null unless all are there), in-distribution leakage over those that
    are, dropped and truncated shares, missing sets."""
    first, near = F.col("testset").isin(primary), F.col("testset").isin(in_dist)
    whole = F.count_distinct(F.when(first, F.col("testset"))) == len(set(primary))
    mean = lambda test, c: F.avg(F.when(test, 100 * F.col(c)))
    share = lambda a, b: F.when(F.sum(F.when(first, F.col(b))) > 0, F.sum(F.when(first, F.col(a))) / F.sum(F.when(first, F.col(b))))
    expected = F.array(*[F.lit(s) for s in [*primary, *in_dist]]).cast("array<string>")
    out = results.groupBy("tag").agg(
        F.when(whole, mean(first, "leakage_chars")).alias("leak"),
        F.when(whole, mean(first, "over_redaction")).alias("over"),
        mean(near, "leakage_chars").alias("in_dist"),
        share("dropped_items", "items").alias("dropped"),
        share("truncated", "outputs").alias("truncated"),
        F.array_except(expected, F.collect_set("testset")).alias("missing"),
    )
    return out.withColumn("sane", F.coalesce(F.col("dropped") <= MAX_DROPPED, F.lit(True)) & F.coalesce(F.col("truncated") <= MAX_TRUNCATED, F.lit(True)))


def choose(cands: DataFrame, sanity: bool = False) -> DataFrame:
    """The winner: least leakage; of those within the tie band least over-redaction, then in-distribution leakage
    (unknown last), then tag. With sanity, unsound runs count only if all are."""
    pool = cands.where("leak is not null")
    if sanity:
        pool = pool.withColumn("_any", F.max("sane").over(Window.partitionBy(F.lit(1)))).where("sane or not _any").drop("_any")
    best = pool.agg(F.min("leak").alias("_best"))
    return pool.crossJoin(F.broadcast(best)).where(F.col("leak") - F.col("_best") < TIE).orderBy("over", F.asc_nulls_last("in_dist"), "tag").limit(1).drop("_best")


def rank_of(overrides: Column) -> Column:
    """Adapter rank named by an override, else 16."""
    named = F.filter(overrides, lambda o: o.startswith("lora.r="))
    return F.when(F.size(named) > 0, F.regexp_extract(F.try_element_at(named, F.lit(1)), r"=(\d+)", 1).cast("int")).otherwise(16)


def verdicts(df: DataFrame) -> DataFrame:
    """df(tag, leak, over, dropped, truncated, base_*, ci_leak_lo, ci_leak_hi, ci_over_hi) with verdict A to D: rejected
    D first, then large leakage gains A, then parity with less over-redaction B, else C."""
    dl, do = F.col("leak") - F.col("base_leak"), F.col("over") - F.col("base_over")
    rel = F.when(F.col("base_leak") != 0, -dl / F.col("base_leak")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    loops = (zero("dropped") > zero("base_dropped") + 0.02) | (zero("truncated") > zero("base_truncated") + 0.01)
    worse = (dl > NOISE) & F.coalesce(F.col("ci_leak_lo") > 0, F.lit(True))
    below = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    verdict = F.when(worse | loops, "D").when((rel >= RELATIVE_GAIN) & below("ci_leak_hi"), "A").when((F.abs(dl) < NOISE) & (-do >= OVER_GAIN) & below("ci_over_hi"), "B").otherwise("C")
    return df.withColumn("verdict", verdict)


def adopt(judged: DataFrame) -> DataFrame:
    """The adopted run (A or B) of least rank, then leakage; none if nothing is adopted."""
    return judged.where(F.col("verdict").isin("A", "B")).orderBy("rank", "leak", "tag").limit(1)


def promoted(df: DataFrame) -> Column:
    """The written promotion rule over points of leakage, over-redaction, invented and truncated shares."""
    c = F.col
    rules = [c("leak") < 5, c("ci_leak_hi") < 0, c("over_diff") <= 1, ~(c("ci_over_lo") > 0), c("invented_diff") <= 2, c("truncated_diff") <= 1, c("other_sets_diff") <= 1]
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules])


def label_report(audit: DataFrame) -> DataFrame:
    """audit(label, verdict) -> spans, errors, rate and Wilson interval per label; unknown verdicts count apart."""
    known = F.col("verdict").isin("ok", "wrong_label", "not_pii", "bad_boundary")
    n, k = F.sum(known.cast("long")), F.sum((known & (F.col("verdict") != "ok")).cast("long"))
    out = audit.groupBy("label").agg(n.alias("n"), k.alias("errors"), F.sum((~known).cast("long")).alias("unknown"))
    lo, hi = wilson(F.col("errors"), F.col("n"))
    return out.select("label", "n", "errors", "unknown", F.round(ratio(F.col("errors"), F.col("n")), 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def latency(df: DataFrame, *keys: str) -> DataFrame:
    """df(ms, chars) -> p50 and p95 milliseconds per 1,000 characters, and characters a second."""
    per = F.col("ms") / F.greatest(F.col("chars"), F.lit(1)) * 1000
    return df.groupBy(*keys).agg(F.round(F.percentile(per, F.lit(0.5)), 4).alias("p50_ms"), F.round(F.percentile(per, F.lit(0.95)), 4).alias("p95_ms"), F.round(F.sum("chars") / (F.sum("ms") / 1000), 4).alias("chars_per_s"))


def delta_rows(df: DataFrame, model: str, whole: str, *keys: str) -> DataFrame:
    """By the keys, leakage and over-redaction in percent of a model's predictions and of the whole's, and what the whole
    changes. Both are counted in one pass over df(text, gold, ...)."""
    both = scored(df, pred=model).select(*keys, F.lit("model").alias("system"), *COUNTS).unionByName(scored(df, pred=whole).select(*keys, F.lit("whole").alias("system"), *COUNTS))
    of = lambda system, a, b: F.round(100 * ratio(F.sum(F.when(F.col("system") == system, F.col(a))), F.sum(F.when(F.col("system") == system, F.col(b)))), 6)
    rows = both.groupBy(*keys).agg(of("model", "leaked_chars", "gold_chars").alias("model_leak"), of("whole", "leaked_chars", "gold_chars").alias("whole_leak"), of("model", "over_chars", "pred_chars").alias("model_over"), of("whole", "over_chars", "pred_chars").alias("whole_over"))
    return rows.withColumn("leak_change", F.round(F.col("whole_leak") - F.col("model_leak"), 6))


def missed_by_label(sheet: DataFrame) -> DataFrame:
    """sheet(missed) with entries 'LABEL: value; ...' -> (label, n); none and - are no entries."""
    entry = sheet.select(F.explode(F.split(F.coalesce("missed", F.lit("")), ";")).alias("entry")).withColumn("entry", F.trim("entry"))
    some = entry.where((F.col("entry") != "") & ~F.lower("entry").isin("none", "-"))
    return some.groupBy(F.upper(F.trim(F.split("entry", ":", 2)[0])).alias("label")).agg(F.count(F.lit(1)).alias("n"))


#: Remarks on spans that are right but of a kind of their own.
REMARKS = ("event_date", "place", "injected")


def remark_counts(audit: DataFrame) -> DataFrame:
    """audit(label, verdict, note) -> (remark, label, n) of right spans whose note begins with a known remark."""
    plain = F.trim(F.regexp_replace(F.trim(F.coalesce("note", F.lit(""))), r"^\[llm\]", ""))
    remark = F.regexp_extract(plain, r"^[^: ]*", 0)
    return audit.where(F.lower(F.trim("verdict")) == "ok").select(remark.alias("remark"), "label").where(F.col("remark").isin(*REMARKS)).groupBy("remark", "label").agg(F.count(F.lit(1)).alias("n"))


def label_seed_mean(results: DataFrame) -> DataFrame:
    """results(seed, label, n_gold, leakage_chars) -> (label, leak): percent of leaked characters averaged over the seeds
    that have the label."""
    return results.where("n_gold > 0").groupBy("label").agg(F.round(F.avg(100 * F.col("leakage_chars")), 2).alias("leak"))


def best_per_set(results: DataFrame, systems: list[str]) -> DataFrame:
    """results(tag, testset, leak) -> the system of least leakage on each set, the first by name of equals."""
    least = F.min(F.struct("leak", "tag"))
    return results.where(F.col("tag").isin(systems)).groupBy("testset").agg(least.alias("b")).select("testset", "b.tag", "b.leak")
