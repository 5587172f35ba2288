"""The queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.functions import detect as d
from opalspan.functions import spans as sp
from opalspan.functions import text as tx
from opalspan.functions.policy import Policy, entities, policy, redacted
from opalspan.operators import bloom, generate, merge, model_output, ordered, prep, rules, scoring, transcripts, vault
from opalspan.plans import redaction
from opalspan.sources.shared import kept, scratch

KEY = bytes(range(32))
SEED = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def found(spark: SparkSession, sf_dir: str, detector=d.validators) -> DataFrame:
    return documents(spark, sf_dir).withColumn("spans", detector(F.col("text")))


def _relation(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.label").alias("label"), F.col("s.text").alias("value"))


def _detector(detector) -> Callable:
    return lambda spark, sf_dir: _relation(found(spark, sf_dir, detector))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with gold spans, and predictions made from them: every fifth document has none, every seventh one
    character more."""
    df = found(spark, sf_dir).withColumnRenamed("spans", "gold")
    longer = F.transform("gold", lambda s: s.withField("end", F.when(F.col("doc_id") % 7 == 0, F.least(s["end"] + 1, F.length("text"))).otherwise(s["end"])))
    return df.withColumn("pred", F.when(F.col("doc_id") % 5 == 0, sp.no_spans()).otherwise(longer.cast(sp.SPANS)))


def shifted_prediction(df: DataFrame) -> DataFrame:
    """Another system: every third document has no predictions."""
    return df.withColumn("pred", F.when(F.col("doc_id") % 3 == 0, sp.no_spans()).otherwise(F.col("gold").cast(sp.SPANS)))


def counts(df: DataFrame, by: str = "lang") -> DataFrame:
    """(set, pos, the six counts) of each document: sets are languages, places are ranks of ids. Counts are written before
    they are ranked, so that texts are searched once, and ranks are running counts, so that no task ranks a language."""
    s = scoring.scored(df)
    slim = kept(s.select(F.col(by).alias("set"), "doc_id", "gold_chars", "leaked_chars", "pred_chars", "over_chars", (F.col("gold_chars") > 0).cast("int").alias("has_gold"), "leaks"), "counts")
    return ordered.before(slim, ["set"], ["doc_id"], name="pos").drop("doc_id")


def q_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = redaction.redact(documents(spark, sf_dir).select("doc_id", "text"), policy("support"), limit=None)
    return df.select("doc_id", "redacted", F.size("entities").alias("n_entities"))


def q_redact(name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = documents(spark, sf_dir).withColumn("spans", merge.recall_first_union(F.col("text"), d.validators(F.col("text"))))
        return df.select("doc_id", redacted(F.col("text"), F.col("spans"), policy(name)).alias("redacted"), F.size("spans").cast("long").alias("n_entities"))

    return run


def q_redact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    return df.select("doc_id", redacted(F.col("text"), F.col("spans"), Policy("hash"), F.lit("default"), KEY).alias("redacted"))


def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = found(spark, sf_dir).select("lang", F.explode(entities(F.col("spans"), policy("analytics"))).alias("e"))
    return e.groupBy("lang", F.col("e.label").alias("label"), F.col("e.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def _crossing(df: DataFrame) -> Column:
    """Spans of a second detector made from the first: begun two characters later, ended three later, of another label."""
    return F.transform("spans", lambda s: sp.span(s["start"] + 2, F.least(s["end"] + 3, F.length("text")), F.lit("OTHER"), F.lit(""), "llm", F.lit(0.5)))


def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    u = df.withColumn("u", merge.recall_first_union(F.col("text"), F.col("spans"), _crossing(df)))
    return u.select("doc_id", F.explode("u").alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.label").alias("label"), F.col("s.source").alias("source"))


def q_union_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    rel = sp.exploded(df.withColumn("all", F.concat("spans", _crossing(df))), "all", "doc_id")
    u = merge.union_relation(rel)
    return u.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "label", "source")


def q_merge_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    later = F.transform("spans", lambda s: sp.span(s["start"] + 1, F.least(s["end"] + 4, F.length("text")), s["label"], F.lit(""), "llm"))
    m = df.withColumn("spans", merge.merge_same_label(F.concat("spans", later)))
    return _relation(m).drop("value")


def q_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    inner = F.transform("spans", lambda s: sp.span(s["start"] + 1, s["end"] - 1, F.lit("OTHER"), F.lit(""), "llm"))
    return _relation(df.withColumn("spans", merge.drop_contained(F.concat("spans", inner)))).drop("value")


def q_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    return _relation(df.withColumn("spans", sp.deduped(F.concat("spans", "spans")))).drop("value")


def q_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prep.mapped(found(spark, sf_dir), {"EMAIL": "EMAIL", "CREDITCARDNUMBER": "CODE"})
    return m.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", sp.masked(F.col("text"), F.col("spans")).alias("masked"))


def q_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", sp.inline_masked(F.col("text"), F.col("spans")).alias("masked"))


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    return df.select("doc_id", F.explode(F.transform("spans", lambda s: F.struct(s["start"].cast("long").alias("start_at"), sp.context(F.col("text"), s).alias("context")))).alias("c")).select("doc_id", "c.*")


def q_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    return df.select("doc_id", F.posexplode(sp.highlights(F.col("text"), F.col("spans"))).alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("place"), "h.segment", "h.label")


def q_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(tx.shingles(tx.words(F.col("text")), 5)).cast("long").alias("n_shingles"))


def q_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 8)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def q_near_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the documents of one language's pool: the English ones."""
    docs, _ = _near(spark, sf_dir)
    pairs = prep.near_duplicates(docs.where("lang <> 'en'"), docs.where("lang = 'en'"), 0.8)
    return pairs.select("id", "other", F.round("jaccard", 6).alias("jaccard"))


def q_near_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all, whatever their language: each pair once, the later document first. Equal texts are
    one class: its first document stands for it in the pairs, the others have a row that names the first."""
    docs, _ = _near(spark, sf_dir)
    # texts are told apart by their SHA-256, and only those met twice are joined. Of whole texts only
    # those are sent that a Bloom filter takes for copies
    named = docs.select("id", F.unhex(F.sha2("text", 256)).alias("t"))
    many = kept(named.groupBy("t").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("k")).where("k > 1").select("t", "other"), "many")
    copies = kept(named.join(many, "t").where("id <> other").select("id", "t", "other"), "copies")
    h = F.xxhash64("id", "t")
    tried = docs.withColumn("t", F.unhex(F.sha2("text", 256))).crossJoin(F.broadcast(bloom.built(copies.select(h.alias("_h")), "_h")))
    maybe = bloom.may_hold(F.col("_bloom"), h)
    # no anti-join: Spark would put it below the filter
    rest = tried.where(maybe).join(copies.select("id", "t", F.lit(True).alias("copy")), ["id", "t"], "left").where("copy is null")
    first = tried.where(~maybe).select("id", "text").unionByName(rest.select("id", "text"))
    return prep.near_duplicates_lsh(first, first, 0.8).unionByName(copies.select("id", "other", F.lit(1.0).alias("jaccard")))


def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strata are made of is written first: the order is sampled, ranked and sorted, and texts are searched once."""
    return prep.stratified_order(kept(found(spark, sf_dir).select("doc_id", "source", "spans"), "strata"), SEED, "source", "doc_id")


def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stratified(spark, sf_dir).select("doc_id", "stratum", F.round("place", 9).alias("place"))


def q_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "spans", F.col("source").alias("region"), "lang")
    sizes = {"dev": 30, "test_id": 30, "test_holdout_regions": 10}
    return prep.splits(df.where("lang = 'en'"), df.where("lang <> 'en'"), 100, [20, 50], sizes, ["src3", "src4"], SEED)


def q_equal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.equal_share_sample(documents(spark, sf_dir), 30, "lang", SEED, "doc_id").select("doc_id", "lang")


def q_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = lambda t: sp.matches(t, r"(?U)\b\d{2}\b", "AGE", "gold")
    df = documents(spark, sf_dir).withColumn("spans", F.concat(d.cards(F.col("text")), ages(F.col("text"))))
    return rules.noise(df).groupBy("rule", "label").agg(F.count(F.lit(1)).alias("n"))


def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir).withColumn("spans", F.transform("spans", lambda s: s.withField("end", s["end"] + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))))
    e = df.select("doc_id", F.explode(sp.span_errors(F.col("text"), F.col("spans"))).alias("error"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def q_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir).withColumn("keep", F.array(F.lit("no such string")))
    return df.select("doc_id", F.explode(rules.record_errors(F.col("text"), F.col("spans"), F.col("keep"))).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def q_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("spans", d.emails(F.col("text")))
    t = prep.transcripts(turns)
    return t.select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def q_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(predicted(spark, sf_dir)).select("doc_id", *scoring.COUNTS)


def q_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall(scoring.scored(predicted(spark, sf_dir)))


def q_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_group(scoring.scored(predicted(spark, sf_dir)), "lang", "source")


def q_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_label(scoring.scored(predicted(spark, sf_dir)))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bootstrap(counts(predicted(spark, sf_dir)), 100, SEED)


def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir)
    return scoring.paired_bootstrap(counts(df), counts(shifted_prediction(df)), 100, SEED)


def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return scoring.label_report(audit.select(F.col("lang").alias("label"), F.when(F.col("quality") == 1, "ok").otherwise("not_pii").alias("verdict")))


def q_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir).select("doc_id", "gold", "pred")
    c = scoring.compare_misses(scoring.missed(df), scoring.missed(shifted_prediction(df)))
    return c.groupBy("status", "label").agg(F.count(F.lit(1)).alias("n"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep results: systems are sources, test sets are languages."""
    s = scoring.scored(predicted(spark, sf_dir)).groupBy(F.col("source").alias("tag"), F.col("lang").alias("testset"))
    return s.agg(scoring.ratio(F.sum("leaked_chars"), F.sum("gold_chars")).alias("leakage_chars"), scoring.ratio(F.sum("over_chars"), F.sum("pred_chars")).alias("over_redaction"), F.sum("n_pred").alias("items"), F.sum("n_pred").cast("long").alias("_n"), F.count(F.lit(1)).alias("outputs")).withColumn("dropped_items", F.lit(0)).withColumn("truncated", F.lit(0)).drop("_n")


def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scoring.candidates(results(spark, sf_dir), ["en"], ["fr", "de"])
    return c.select("tag", F.round("leak", 6).alias("leak"), F.round("over", 6).alias("over"), F.round("in_dist", 6).alias("in_dist"), "sane")


def q_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = scoring.choose(scoring.candidates(results(spark, sf_dir), ["en"], ["fr", "de"]), True)
    return w.select("tag", F.round("leak", 6).alias("leak"), F.round("over", 6).alias("over"))


DECISIONS = """
('a', 20.0, 30.0, 25.0, 30.0, -6.0, -2.0, 1.0), ('b', 25.05, 27.0, 25.0, 30.0, -0.5, 0.6, -1.0), ('c', 24.0, 30.0, 25.0, 30.0, -2.0, 0.4, 1.0),
('d', 27.0, 28.0, 25.0, 30.0, 1.0, 3.0, -1.0), ('e', 25.1, 29.5, 25.0, 30.0, -0.2, 0.5, -0.1), ('f', 19.0, 33.0, 25.0, 30.0, -9.0, 0.5, 2.0)
"""


def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"select col1 tag, double(col2) leak, double(col3) over, double(col4) base_leak, double(col5) base_over, double(col6) ci_leak_lo, double(col7) ci_leak_hi, double(col8) ci_over_hi, double(null) dropped, double(null) truncated, double(null) base_dropped, double(null) base_truncated from values {DECISIONS}")
    return scoring.verdicts(rows).select("tag", "verdict")


def q_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.scored(predicted(spark, sf_dir)).groupBy("source").pivot("lang", ["de", "en", "es", "fr"])
    return r.agg(F.round(scoring.ratio(F.sum("leaked_chars"), F.sum("gold_chars")), 6))


def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.statistics(found(spark, sf_dir))


def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latency(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"), (F.length("props") + 1).alias("chars")), "event_type")


def q_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of each document's first two words: whole, in a fence, cut off inside the second item, or as prose
    with one item; in turn by id."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs = documents(spark, sf_dir).select("doc_id", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).where("b is not null")
    item = lambda lab, v: F.concat(F.lit('{"label": "' + lab + '", "text": "'), v, F.lit('"}'))
    first, both = item("GIVENNAME", F.col("a")), F.concat(F.lit("["), item("GIVENNAME", F.col("a")), F.lit(", "), item("CITY", F.concat("b", F.lit(' \\"x\\"'))), F.lit("]"))
    turn = F.col("doc_id") % 4
    raw = F.when(turn == 0, both).when(turn == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(turn == 2, F.concat(F.lit("["), first, F.lit(', {"label": "CITY", "te'))).otherwise(F.concat(F.lit("Sure. "), first, F.lit(" and more")))
    parsed = docs.select("doc_id", model_output.parsed(raw).alias("p"))
    return parsed.select("doc_id", F.col("p.valid_json").alias("valid_json"), F.explode_outer("p.items").alias("i")).select("doc_id", "valid_json", "i.label", "i.text")


def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found in documents are given back in reverse order, upper-cased, and must be found again."""
    df = found(spark, sf_dir).where(F.size("spans") > 0)
    items = F.reverse(F.transform("spans", lambda s: F.struct(F.lit("EMAIL").alias("label"), F.upper(s["text"]).alias("text"))))
    a = df.withColumn("a", model_output.aligned(F.col("text"), items))
    return a.select("doc_id", F.size("spans").alias("n_items"), F.size("a.spans").alias("n_found"), F.size("a.dropped").alias("n_dropped"))


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output.chunked(documents(spark, sf_dir).select("doc_id", "text"), 1500, 200).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


def q_detect_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model_output.detect_chunked(documents(spark, sf_dir).select("doc_id", "text"), d.emails, 1500, 200)
    return _relation(out).drop("value")


def q_bioes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of conversations tagged by the first letter's case: capitalised words begin or go on a name."""
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.concat_ws(":", "conv_id", "turn")).withColumn("text", F.coalesce("text", F.lit("")))
    tokens = turns.select("doc_id", "text", F.explode(sp.matches(F.col("text"), r"(?U)\w+", "X")).alias("s"))
    tags = tokens.select("doc_id", "text", "s.start", "s.end", F.when(F.col("s.text").rlike(r"^\p{Lu}"), "I-NAME").otherwise("O").alias("entity"), F.lit(0.5).alias("score"))
    return model_output.bioes(tags).select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "label")


def q_split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names put together from customers: title, segment as given name, particle and region as surname; some are a
    title and a surname, a surname alone, or the customer's placeholder."""
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    k, proper = F.col("c_custkey"), lambda x: F.initcap(F.lower(F.replace(F.col(x), F.lit(" "), F.lit(""))))
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (k % n + 1).cast("int"))
    title, particle = pick(4, "Dr.", "Ms", None, "Prof."), pick(3, None, "van", "de la")
    name = F.when(k % 7 == 0, F.col("c_name")).when(k % 5 == 0, F.concat_ws(" ", title, proper("r_name"))).otherwise(F.concat_ws("  ", title, proper("c_mktsegment"), particle, proper("r_name")))
    return c.select("c_custkey", tx.split_name(name).alias("p")).select("c_custkey", "p.title", "p.given", "p.surname")


def q_normalise_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with Cyrillic a and o and a zero-width space after each e come back as they were; last: the
    place of the last character in what was written."""
    docs = documents(spark, sf_dir).where(F.col("text") != "").select("doc_id", F.replace(F.translate("text", "ao", "ао"), F.lit("e"), F.lit("e\u200b")).alias("text"))
    n = docs.select("doc_id", tx.normalised(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5("n.text").alias("digest"), F.size("n.origin").cast("long").alias("n_origin"), F.element_at("n.origin", -1).cast("long").alias("last"))


def q_iban_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account number for each customer, with wrong check digits for every third one."""
    bban = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    check = 98 - F.concat(bban, F.lit("131400")).cast("decimal(38,0)") % 97 + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)
    text = F.concat(F.lit("Pay to DE"), F.lpad(check.cast("int").cast("string"), 2, "0"), bban, F.lit(" now"))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), d.ibans(text).alias("spans"))
    return _relation(df)


def q_ipv6_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a gap, whole ones, and two kinds of broken ones, in turn by customer."""
    k = F.lower(F.hex(F.col("c_custkey") % 65536))
    address = F.element_at(F.array(F.concat(F.lit("2001:db8::"), k), F.concat(F.lit("1:2:3:4:5:6:7:"), k), F.concat(F.lit("1:2:3:4:5:6:7:8:"), k), F.concat(F.lit("fe80::1::"), k)), (F.col("c_custkey") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), d.ipv6(F.concat(F.lit("from "), address, F.lit(" to"))).alias("spans"))
    return _relation(df)


def q_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all: pairs of classes of equal shingle sets, and the members of each class."""
    docs, _ = _near(spark, sf_dir)
    return prep.near_duplicates_within(docs, 0.8).select("id", "other", F.round("jaccard", 6).alias("jaccard"))


def q_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's second, first and fourth word, given without places, are placed."""
    w = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))
    docs = documents(spark, sf_dir).where(F.size(w) >= 4)
    given = F.transform(F.array(F.lit(1), F.lit(0), F.lit(3)), lambda i: F.struct(F.lit("CITY").alias("label"), F.get(w, i).alias("text")))
    f = docs.select("doc_id", F.explode(rules.filled(F.col("text"), given)).alias("s"))
    return f.select("doc_id", F.col("s.place").cast("long").alias("place"), F.col("s.start").cast("long").alias("start_at"), F.col("s.text").alias("value"))


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = documents(spark, sf_dir).select("doc_id", model_output.messages(F.col("text")).alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("n"), F.get(F.col("m"), F.lit(0))["role"].alias("role"), F.md5(F.get(F.col("m"), F.lit(0))["content"]).alias("digest"))


def q_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions alone against predictions with the detectors beside them, by source and language."""
    df = predicted(spark, sf_dir).withColumn("both", merge.recall_first_union(F.col("text"), F.col("pred"), F.filter("gold", lambda s: s["label"] == "EMAIL")))
    return scoring.delta_rows(df, "pred", "both", "source", "lang")


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents with the verdicts that there are; the others are ok. Rules that fire, by verdict."""
    spans = prep.numbered_spans(found(spark, sf_dir))
    given = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(0).alias("span_idx"), F.lit("not_pii").alias("verdict"))
    return prep.audited(spans, given).groupBy("label", "verdict").agg(F.count(F.lit(1)).alias("n"))


def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", tx.normalised(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5("n.text").alias("digest"), F.size(F.coalesce("n.origin", F.array().cast("array<int>"))).alias("n_origin"))


def q_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    out, _ = vault.pseudonymised(m, policy("analytics"), KEY)
    return out.select("conversation", "turn", "redacted")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with every capitalised word of four letters or more taken for a given name."""
    m = table(spark, sf_dir, "conversations").select(F.lit("t1").alias("tenant"), F.col("conv_id").cast("string").alias("conversation"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    return m.withColumn("spans", sp.matches(F.col("text"), r"(?U)\b\p{Lu}\p{Ll}{3,}\b", "GIVENNAME", "gold"))


def q_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    out, held = vault.pseudonymised(m, policy("analytics"), KEY)
    # random nonces must be drawn once: the vault is a table in the shared folder, not a plan
    path = scratch(spark, "vault")
    held.write.parquet(path)
    held = spark.read.parquet(path)
    back = vault.restored(out.select("tenant", "conversation", "turn", F.col("redacted").alias("text")), held, KEY)
    return back.select("conversation", "turn", F.md5("restored").alias("digest"))


def q_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    flat = m.select("tenant", "conversation", "turn", F.explode("spans").alias("s")).select("tenant", "conversation", "turn", "s.start", "s.label", F.col("s.text").alias("value"))
    return vault.tokens(flat, KEY).select("conversation", "label", F.col("n").cast("long").alias("n"), "token")


def q_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vault.limited(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 5)
    return e.select("event_id", "in_minute", "in_day", "allowed")


def q_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as conversations, at a time when those have expired whose first event is in the first hour of all."""
    e = table(spark, sf_dir, "events").select(F.lit("t1").alias("tenant"), F.col("user_id").alias("conversation"), F.col("ts").alias("created"))
    first = e.agg(F.unix_timestamp(F.min("created"))).first()[0] or 0
    p = vault.purged(e, F.timestamp_seconds(F.lit(first + vault.TTL_SECONDS + 3600)))
    return p.select("conversation", "created")


def q_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generated(spark, 200, SEED).select("id", "label", "value", "start", "end")


def q_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, redacted into files of the shared folder."""
    from opalspan.streaming.redact import redact_stream

    path = scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    q = redact_stream(stream, policy("support")).select("doc_id", "redacted").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id long, redacted string").parquet(f"{path}/out")


def q_unspoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers spoken, with words around them that say no digit, and understood again."""
    number = F.concat(F.col("c_custkey").cast("string"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("0055"), F.translate(F.round("c_acctbal", 0).cast("long").cast("string"), "-", ""))
    said = F.concat(F.lit("Plus "), tx.spoken(number), F.lit(", um, four/ONE-"), tx.spoken(F.col("c_nationkey").cast("string")), F.lit(". a4b5 double um five hundred"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.unspoken(said).alias("digits"))


def q_missed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a sheet of missed values: two for toxic documents, none or a dash for others."""
    entries = F.when(F.col("toxic") == 1, F.concat(F.lit("city: X; Street : "), F.col("doc_id").cast("string"))).when(F.col("quality") == 1, F.lit("none")).otherwise(F.lit(" - ;"))
    return scoring.missed_by_label(table(spark, sf_dir, "labels").select(entries.alias("missed")))


def q_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("[llm] place: a"), F.lit("event_date"), F.lit("other place"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "CITY").otherwise("DATE").alias("label"), F.when(F.col("quality") == 1, "OK ").otherwise("not_pii").alias("verdict"), kind.alias("note"))
    return scoring.remark_counts(rows)


def q_best_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).select("tag", "testset", F.round("leakage_chars", 9).alias("leak"))
    return scoring.best_per_set(r, ["src1", "src2", "src3", "src4"])


def q_seed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as seeds: labels' leakage averaged over the sources that have them."""
    per = predicted(spark, sf_dir).where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("seed"), "doc_id", "text", F.explode("gold").alias("g"), "pred")
    leaked = F.size(F.array_except(sp.positions(F.array("g")), sp.positions(F.col("pred"))))
    rows = per.groupBy("seed", F.col("g.label").alias("label")).agg(F.count(F.lit(1)).alias("n_gold"), scoring.ratio(F.sum(leaked), F.sum(F.col("g.end") - F.col("g.start"))).alias("leakage_chars"))
    return scoring.label_seed_mean(rows)


def q_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by document: answers are whole, broken, without the message, or without the value, in turn by id."""
    docs = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4).alias("turn"))
    text = F.concat(F.lit("Please write to Ann about it"), F.when(F.col("turn") == 3, "").otherwise(" in Leeds today"))
    whole = F.to_json(F.struct(F.array(F.struct(F.when(F.col("turn") == 2, "other").otherwise("s").alias("id"), text.alias("text"), F.array().cast("array<string>").alias("keep"))).alias("messages")))
    responses = docs.select(F.col("doc_id").alias("request"), F.when(F.col("turn") == 1, F.substr(whole, F.lit(1), F.lit(20))).otherwise(whole).alias("content"))
    values = F.array(F.struct(F.lit("GIVENNAME").alias("label"), F.lit("Ann").alias("text")), F.struct(F.lit("CITY").alias("label"), F.lit("Leeds").alias("text")))
    specs = docs.select(F.col("doc_id").alias("request"), F.lit("s").alias("id"), values.alias("values"), F.array().cast("array<string>").alias("keep"))
    return rules.collected(responses, specs).select(F.col("request").alias("doc_id"), "reason", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"))


def q_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    mixed = prep.mixture({"english": docs.where("lang = 'en'"), "other": docs.where("lang <> 'en'")}, SEED, "doc_id")
    return mixed.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def q_transcript_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each customer, by an agent, with what the customer's card holds and a user name."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("555"), F.lpad(k.cast("string"), 7, "0"))
    layout = F.concat(F.lit("(555) "), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 4))
    surname = F.concat(F.lit("Q"), F.lower(F.translate(k.cast("string"), "0123456789", "abcdefghij")))
    street = F.concat(F.lit("Elm "), surname, F.lit(" Road"))
    card = F.struct(F.concat(F.lit("Ann "), surname).alias("name"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org")).alias("email"), phone.alias("phone"), F.concat((k + 10).cast("string"), F.lit(" "), street).alias("street_address"), F.lit("Leeds").alias("city"), F.lit(None).cast("string").alias("zip_code"), F.array(F.concat(F.lit("ord-"), k.cast("string"))).alias("ignored"))
    text = F.concat(F.lit("Hi, my name is Bob. ANN "), surname, F.lit(", call "), layout, F.lit(" about ord-"), k.cast("string"), F.lit(". "), (k + 10).cast("string"), F.lit(" "), street, F.lit(" or 7 "), street, F.lit(", leeds. Username is zed."))
    # a customer is a few bytes and much work, so rows are dealt to tasks by their number; spans come sorted
    customers = table(spark, sf_dir, "customer").select("c_custkey").repartition(ordered.parts(spark), "c_custkey")
    return customers.select("c_custkey", F.array_join(F.transform(transcripts.turn_spans(text, card, F.lit(True)), lambda x: F.concat(x["label"], F.lit("="), x["text"])), "|").alias("labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_emails": _detector(d.emails),
    "detect_cards_luhn": _detector(d.cards),
    "detect_ipv4": _detector(d.ipv4),
    "detect_phones": _detector(d.phones),
    "detect_validators": _detector(d.validators),
    "iban_mod97": _detector(d.ibans),
    "detect_ipv6": _detector(d.ipv6),
    "span_union_recall_first": q_union,
    "span_union_relation": q_union_relation,
    "span_merge_same_label": q_merge_same,
    "span_drop_contained": q_contained,
    "span_dedupe": q_dedupe,
    "redact_mask_support": q_redact("support"),
    "redact_strict": q_redact("strict"),
    "redact_hash": q_redact_hash,
    "pseudonymize_conversations": q_pseudonymise,
    "token_numbering": q_numbering,
    "restore_roundtrip": q_restore,
    "entities_by_label": q_entities,
    "label_map_default": q_label_map,
    "mask_template": q_mask,
    "inline_masked": q_inline,
    "context_window": q_context,
    "highlights": q_highlights,
    "shingles_5": q_shingles,
    "ngram_contamination_benchmark": q_contamination,
    "near_dup_exact_jaccard": q_near_exact,
    "near_dup_lsh": q_near_lsh,
    "near_dup_exact_classes": q_near_classes,
    "stratified_order": q_stratified,
    "nested_prefix_splits": q_splits,
    "equal_share_sample": q_equal_share,
    "noise_rules": q_noise,
    "span_validation_errors": q_errors,
    "record_errors": q_record_errors,
    "transcript_assembly": q_transcripts,
    "score_docs": q_scored,
    "metrics_overall": q_overall,
    "metrics_by_group": q_by_group,
    "metrics_by_label": q_by_label,
    "bootstrap_ci": q_bootstrap,
    "paired_bootstrap": q_paired,
    "wilson_error_rate": q_wilson,
    "known_misses": q_misses,
    "sweep_candidates": q_candidates,
    "select_winner_tie_band": q_winner,
    "decision_matrix": q_decisions,
    "result_pivot": q_pivot,
    "extract_stats": q_statistics,
    "latency_percentiles": q_latency,
    "parse_llm_json": q_parse,
    "align_spans": q_align,
    "chunk_text": q_chunks,
    "detect_chunked": q_detect_chunked,
    "bioes_decode": q_bioes,
    "split_name": q_split_name,
    "normalize_offsets": q_normalise,
    "rate_limit_sliding": q_limit,
    "vault_ttl_purge": q_purge,
    "generated_values": q_generated,
    "stream_redact": q_stream,
    "spoken_digits": q_unspoken,
    "normalize_look_alikes": q_normalise_seeded,
    "iban_seeded": q_iban_seeded,
    "ipv6_seeded": q_ipv6_seeded,
    "fill_offsets": q_filled,
    "prompt_messages": q_messages,
    "gateway_deltas": q_deltas,
    "audit_verdicts": q_audit,
    "missed_by_label": q_missed_labels,
    "audit_remarks": q_remarks,
    "best_baseline_per_set": q_best_per_set,
    "label_seed_mean": q_seed_labels,
    "collect_responses": q_collected,
    "training_mixture": q_mixture,
    "transcript_cards": q_transcript_cards,
}
