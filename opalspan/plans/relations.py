"""Queries over relations of spans and values of any size, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.functions import detect as d
from opalspan.functions import spans as sp
from opalspan.operators import bloom, intervals, lsh_index, ordered, prep, quantiles, rules, scoring
from opalspan.plans.oracle import _GOLD, _SHINGLES, FOUND, ORACLE
from opalspan.plans.queries import SEED, _crossing, documents, found, predicted, table
from opalspan.sources.shared import scratch

SHARES = (0.01, 0.5, 0.95, 0.999)
REPLICATES = 100


def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and predictions of a document that overlap."""
    df = predicted(spark, sf_dir).select("doc_id", "gold", "pred")
    side = lambda c: sp.exploded(df, c, "doc_id").select("doc_id", "start", "end", "label")
    pairs = intervals.overlapping(side("gold"), side("pred"))
    return pairs.select("doc_id", *[F.col(f"{x}.{c}").cast("long").alias(f"{n}_{c}") for x, n in (("a", "gold"), ("b", "pred")) for c in ("start", "end")])


def q_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir).select("doc_id", "gold", "pred")
    side = lambda c: sp.exploded(df, c, "doc_id").select("doc_id", "start", "end", "label")
    return intervals.missed(side("gold"), side("pred")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    u = intervals.union(sp.exploded(df.withColumn("all", F.concat("spans", _crossing(df))), "all", "doc_id"))
    return u.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "label", "source")


def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by return flag: a few groups that hold all rows."""
    out = quantiles.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", list(SHARES))
    return out.select("l_returnflag", "share", F.round("value", 4).alias("price"))


def q_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.poisson_bootstrap(scoring.scored(predicted(spark, sf_dir)), "doc_id", "lang", REPLICATES, SEED)


def q_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language, in order of id: documents of over 1,000 characters until there are 40, and those passed over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    _, counts = ordered.taken(docs.where("lang is not null"), ["doc_id"], F.col("size") > 1000, 40, ["lang"])
    return counts


def q_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 8)


def q_scored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples and predictions as two tables; every fifth document has none of the latter."""
    df = predicted(spark, sf_dir)
    predictions = df.where("doc_id % 5 <> 0").select("doc_id", F.col("pred").alias("spans"))
    return scoring.scored_predictions(df.select("doc_id", "text", F.col("gold").alias("spans")), predictions, "doc_id").select("doc_id", *scoring.COUNTS)


def q_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' sentences: an age, of a person or a group by the key, or a card's number that is money; 40 and 10,000
    kept."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("Aged "), (20 + k % 60).cast("string"), F.lit(" percent of them"))).when(k % 3 == 1, F.concat(F.lit("He is "), (20 + k % 60).cast("string"), F.lit(" now"))).otherwise(F.lit("total 4111111111111111 million"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), said.alias("text")).withColumn("spans", F.concat(d.cards(F.col("text")), sp.matches(F.col("text"), r"(?U)\b\d{2}\b", "AGE", "gold")))
    kept, report = rules.cleaned(df, ["doc_id"], (40, 10_000))
    last = kept.where("rank in (1, 40)").select(F.concat(F.lit("kept at "), F.col("rank").cast("string")).alias("name"), F.col("doc_id").alias("n"))
    return report.unionByName(last)


def q_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every tenth one twice more, every seventh with a kept string that is not there."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("copy", F.explode(F.when(F.col("doc_id") % 10 == 0, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0)))))
    keep = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("no such string"))).otherwise(F.array().cast("array<string>"))
    out = rules.record_check(docs.withColumn("spans", sp.no_spans()).withColumn("keep", keep), ["doc_id", "copy"], "doc_id")
    return out.groupBy("doc_id", "error").agg(F.count(F.lit(1)).alias("n"))


def q_bad_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents whose spans, moved by one for even ids, are wrong."""
    df = found(spark, sf_dir).withColumn("spans", F.transform("spans", lambda s: s.withField("end", s["end"] + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))))
    bad = prep.bad_examples(df.select("doc_id", sp.span_errors(F.col("text"), F.col("spans")).alias("errors")), "doc_id", "doc_id")
    return bad.select("doc_id", F.array_join("errors", "; ").alias("errors"))


def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents with even ids, to which those with odd ids are joined."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    path = scratch(spark, "index")
    index = lsh_index.Index(spark, f"index_{path[-32:]}", path)
    index.add(docs.where("id % 2 = 0"))
    return index.near(docs.where("id % 2 = 1")).select("id", "other", F.round("jaccard", 6).alias("jaccard"))


_DRAWN = " + ".join(f"(u >= {t})::int" for t in scoring.DRAWS)
_SUMS = ", ".join(f"sum({c} * draws) as {c}" for c in ("leaked_chars", "gold_chars", "over_chars", "pred_chars", "leaks", "has_gold"))
_POISSON = f"""
with {_GOLD}, c as (select doc_id, lang, leaked_chars, gold_chars, over_chars, pred_chars, leaks, (gold_chars > 0)::int as has_gold from full_scores where lang is not null),
n as (select c.*, rep, ('0x' || substr(md5('{SEED}|' || doc_id || '|' || rep // 8), rep % 8 * 4 + 1, 4))::int as u from c, range({REPLICATES}) r(rep)),
s as (select lang, rep, {_SUMS} from (select *, {_DRAWN} as draws from n) where draws > 0 group by all union all select lang, null, {_SUMS} from (select *, 1 as draws from c) group by lang),
r as (select lang as set, rep, case when gold_chars > 0 then leaked_chars / gold_chars else 0 end as leak, case when pred_chars > 0 then over_chars / pred_chars else 0 end as over, case when has_gold > 0 then leaks / has_gold else 0 end as doc from s),
m as (unpivot r on leak, over, doc into name metric value x)
select set, metric, round(max(x) filter (rep is null), 6) as point, round(quantile_cont(x, 0.025) filter (rep is not null), 6) as lo, round(quantile_cont(x, 0.975) filter (rep is not null), 6) as hi from m group by all
"""

#: Name -> (query, its SQL).
RELATIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "interval_pairs": (q_pairs, f"with {_GOLD} select g.doc_id, g.start_at as gold_start, g.end_at as gold_end, p.start_at as pred_start, p.end_at as pred_end from gold g join pred p on p.doc_id = g.doc_id and p.start_at < g.end_at and g.start_at < p.end_at"),
    "interval_missed": (q_missed, f"with {_GOLD} select label, count(*) as n from gold g where not exists (select 1 from pred p where p.doc_id = g.doc_id and p.start_at < g.end_at and g.start_at < p.end_at) group by label"),
    "span_union_ranges": (q_union, ORACLE["span_union_relation"]),
    "percentiles_exact": (q_percentiles, " union all ".join(f"select l_returnflag, {q}::double as share, round(quantile_cont(l_extendedprice, {q}), 4) as price from lineitem group by l_returnflag" for q in SHARES)),
    "poisson_bootstrap": (q_poisson, _POISSON),
    "contamination_filtered": (q_filtered, ORACLE["ngram_contamination_benchmark"]),
    "score_two_tables": (q_scored_tables, ORACLE["score_docs"]),
    "cleaned_first_n": (q_cleaned, "with c as (select c_custkey as k, row_number() over (order by c_custkey) as r from customer where c_custkey % 3 = 1) select 'pool' as name, count(*) as n from customer union all select 'kept', count(*) from c having count(*) > 0 union all select 'dropped', count(*) from customer where c_custkey % 3 <> 1 having count(*) > 0 union all select 'rule age_not_a_person', count(*) from customer where c_custkey % 3 = 0 having count(*) > 0 union all select 'rule money_as_card', count(*) from customer where c_custkey % 3 = 2 having count(*) > 0 union all select 'first 40', least(40, count(*)) from c having count(*) > 0 union all select 'first 10000', least(10000, count(*)) from c having count(*) > 0 union all select 'kept at ' || r, k from c where r in (1, 40)"),
    "record_check": (q_records, "select doc_id, 'duplicate id' as error, 2::bigint as n from documents where doc_id % 10 = 0 union all select doc_id, 'kept string absent no such string', (case when doc_id % 10 = 0 then 3 else 1 end)::bigint from documents where doc_id % 7 = 0"),
    "bad_examples": (q_bad_examples, f"with {FOUND}, e as (select doc_id, case when end_at + 1 > len(text) then 'end past text: ' else 'text differs: ' end || label as error, row_number() over (partition by doc_id order by start_at, end_at, label) as r from found join docs using (doc_id) where doc_id % 2 = 0) select doc_id, string_agg(error, '; ' order by r) as errors from e where r <= 3 group by doc_id order by doc_id limit 5"),
    "near_dup_index": (q_index, f"with {_SHINGLES}, ex as (select doc_id, len(s) as n, unnest(s) as g from sh where doc_id % 2 = 1), pool as (select min(doc_id) as doc_id, s from (select doc_id, list_sort(s) as s from sh where doc_id % 2 = 0) group by s), pe as (select doc_id, len(s) as n, unnest(s) as g from pool), hit as (select a.doc_id as id, b.doc_id as other, a.n as n, b.n as m, count(*) as k from ex a join pe b using (g) group by all) select id, other, round(k / (n + m - k), 6) as jaccard from hit where k / (n + m - k) >= 0.8"),
    "taken_until": (q_taken, "with d as (select lang, doc_id, coalesce(len(text), 0) > 1000 as good from documents where lang is not null), s as (select *, coalesce(sum(good::int) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as earlier from d) select lang, count(*) filter (good) as accepted, count(*) filter (not good) as dropped from s where earlier < 40 group by lang"),
}
