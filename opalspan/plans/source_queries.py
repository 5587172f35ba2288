"""Queries that write the driver's tables in each file format, read them back, and the SQL of what must come back."""

from __future__ import annotations

import gzip
import io
import json
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.functions import detect as d
from opalspan.functions import spans as sp
from opalspan.operators import prep
from opalspan.plans.oracle import FOUND
from opalspan.plans.queries import documents, found, table
from opalspan.sources import files
from opalspan.sources.shared import get, put, scratch


def _examples(spark: SparkSession, sf_dir: str) -> str:
    """The path of documents as examples with the spans that the detectors find."""
    path = scratch(spark, "examples")
    files.write_examples(found(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", "spans", F.map_filter(F.create_map(F.lit("language"), "lang"), lambda k, v: v.isNotNull()).alias("meta")), path)
    return path


def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = files.read_examples(spark, _examples(spark, sf_dir))
    return back.select("id", F.md5("text").alias("digest"), F.col("meta")["language"].alias("language"), F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("found_values"))


def q_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "raw")
    documents(spark, sf_dir).select("doc_id", F.col("lang").alias("language"), "text").write.json(path)
    return files.read_filtered(spark, path, "doc_id long, language string, text string", "en").select("doc_id", F.md5("text").alias("digest"))


def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit('"a", '), "text", F.lit('\nb"')).alias("text")), path)
    return files.read_csv(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("digest"))


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a sheet: quality as verdicts of spans, toxic documents as missed values."""
    path = scratch(spark, "verdicts")
    row = lambda *values: F.struct(F.col("doc_id").alias("doc"), *[v.alias(n) for v, n in zip(values, ("span", "verdict", "correct", "note"))])
    verdict = row(F.lit("0"), F.when(F.col("quality") == 1, "ok").otherwise("not_pii"), F.lit("-"), F.lit("n"))
    missed = F.when(F.col("toxic") == 1, row(F.lit("MISSED"), F.lit("some value"), F.lit("CITY"), F.lit("m")))
    sheet = table(spark, sf_dir, "labels").select(F.explode(F.array(verdict, missed)).alias("r")).where("r is not null").select("r.*")
    sheet.write.option("sep", "\t").option("header", True).csv(path)
    put(spark, f"{path}/remarks.csv", b"# a remark\ndoc\tspan\tverdict\tcorrect\tnote\n# another\n")
    spans, missed = files.read_verdicts(spark, path)
    of = spans.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).select(F.lit("span").alias("kind"), "verdict", "n")
    return of.unionByName(missed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missed").alias("kind"), F.col("label").alias("verdict"), "n"))


def q_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, df = scratch(spark, "predictions"), found(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("spans").alias("pred"))
    files.write_predictions(df, path, "all", "en")
    files.write_predictions(df.withColumn("pred", F.filter("pred", lambda s: s["label"] == "EMAIL")), path, "emails", "en")
    back = spark.read.schema(f"{files.PREDICTION}, tag string, testset string").json(path)
    return back.groupBy("tag", "testset").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("pred")).alias("n_spans"))


def q_raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "raw_log")
    lines = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("offset"), F.length("text").alias("chunk_len"), F.lit("[]").alias("raw"), F.lit(True).alias("valid_json"), (F.length("text") > 1000).alias("truncated"))
    lines.write.json(path)
    return files.read_raw_log(spark, path).groupBy("truncated").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_len").alias("chars"), F.sum(F.coalesce(F.size("dropped"), F.lit(0))).cast("long").alias("n_dropped"))


def _benchmark_rows(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The benchmark is a small, fixed table."""
    return [r.asDict() for r in table(spark, sf_dir, "benchmark").collect()]


def q_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/rows.json", json.dumps(_benchmark_rows(spark, sf_dir)))
    path = put(spark, scratch(spark, "zip") + ".zip", out.getvalue())
    return files.read_zip_json(spark, path, "a/rows.json", "item_id long, text string").select("item_id", F.md5("text").alias("digest"))


def q_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = put(spark, scratch(spark, "gzip") + ".json.gz", gzip.compress(json.dumps(_benchmark_rows(spark, sf_dir), indent=1).encode()))
    return files.read_gzip_json(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("digest"))


def q_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same span as a Python literal and as JSON; every third literal is broken."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.length("lang").alias("n"), "lang")
    literal = F.concat(F.lit("[{'start': 0, 'end': "), "n", F.lit(", 'label': None, 'text': '"), "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise("'}]"))
    text = F.concat(F.lit('[{"start": 0, "end": '), "n", F.lit(', "label": null, "text": "'), "lang", F.lit('"}]'))
    both = docs.select("doc_id", files.literal_column(literal).alias("a"), files.json_column(text).alias("b"))
    return both.select("doc_id", F.get(F.col("a"), F.lit(0))["end"].alias("literal_end"), F.get(F.col("a"), F.lit(0))["text"].alias("literal_text"), F.get(F.col("b"), F.lit(0))["text"].alias("json_text"))


def q_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named set with addresses and numbers out of scope, and the same with them."""
    sets = files.Catalogue({"docs": _examples(spark, sf_dir)})
    one = lambda checked: sets.load(spark, "docs", checked=checked).select(F.lit(checked).alias("checked"), F.explode("spans").alias("s")).groupBy("checked", F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return one(False).unionByName(one(True))


def q_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file for each source and language, of which those without a latency are left out."""
    path = scratch(spark, "results")
    groups = documents(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    for r in groups.where("source in ('src1', 'src2', 'src3')").collect():
        out = {"metrics": {"leakage_chars": r["n"] / 1000, "over_redaction": 0.5, "llm_output": {"items": r["n"], "dropped_items": 1, "outputs": r["n"], "truncated": 0}}}
        out |= {"latency": {"p50_ms_per_1k_chars": 1.0, "p95_ms_per_1k_chars": 2.0, "chars_per_s": float(r["chars"])}} if r["source"] != "src3" else {}
        put(spark, f"{path}/{r['source']}__{r['lang']}.json", json.dumps(out, indent=1).encode())
    back = files.read_results(spark, f"{path}/*.json")
    return back.select("tag", "testset", F.round("leakage_chars", 6).alias("leakage_chars"), "items", "dropped_items", "chars_per_s")


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each nation; those of even keys have all their results."""
    nations = [(r["n_nationkey"], r["n_name"]) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    path = put(spark, scratch(spark, "runs") + ".txt", ("# tag | config | overrides | sets\n" + "".join(f"{name} | c.yaml | a={key} | x y\n\n" for key, name in nations)).encode())
    runs = files.read_runs(spark, path, 1, 3)
    have = table(spark, sf_dir, "nation").select(F.col("n_name").alias("tag"), F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).alias("testset"))
    return files.pending_runs(runs, have).select("tag", "overrides", F.size("sets").alias("n_sets"))


def q_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label map read from YAML in the shared folder, applied to what the detectors find."""
    path = put(spark, scratch(spark, "labels") + ".yaml", b"labels:\n  EMAIL: CONTACT\n  TELEPHONENUM: CONTACT\n")
    mapping = files.label_map(get(spark, path).decode())
    m = prep.mapped(found(spark, sf_dir), mapping)
    return m.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def q_statistics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language written to a file of statistics, then those of English again, doubled: the last one wins."""
    path = scratch(spark, "statistics") + ".json"
    counts = {r["lang"]: r["n"] for r in documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r["lang"]}
    put(spark, path, files.updated_json("", counts).encode())
    put(spark, path, files.updated_json(get(spark, path).decode(), {"en": 2 * counts.get("en", 0)}).encode())
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("lang", "n"))


def q_restored_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 and S6: raw rows with masks, converted; a mask whose value differs from its slice empties the row."""
    df = documents(spark, sf_dir).withColumn("spans", d.emails(F.col("text")))
    wrong = F.col("doc_id") % 4 == 0
    raw = df.select(F.col("doc_id").alias("uid"), F.col("text").alias("source_text"), F.col("lang").alias("language"), F.col("source").alias("region"), F.transform("spans", lambda s: F.struct(F.when(wrong, F.concat(s["text"], F.lit("x"))).otherwise(s["text"]).alias("value"), s["start"], s["end"], s["label"])).alias("privacy_mask"))
    path = scratch(spark, "raw_rows")
    raw.write.parquet(path)
    out = prep.convert_rows(spark.read.parquet(path))
    return out.select("id", F.size("spans").cast("long").alias("n_spans"), F.col("errors").cast("long").alias("n_errors"), F.col("meta")["region"].alias("region"))


_VALUES = f"{FOUND}, per as (select doc_id, count(*) as n, string_agg(value, '|' order by start_at, end_at, label) as v from found group by doc_id)"
_BENCH = "select item_id, md5(text) as digest from benchmark"

#: Name -> (query, SQL).
SOURCES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_jsonl": (q_jsonl, f"with {_VALUES} select cast(d.doc_id as varchar) as id, md5(d.text) as digest, d.lang as language, coalesce(p.n, 0) as n_spans, coalesce(p.v, '') as found_values from docs d left join per p using (doc_id)"),
    "source_filtered_json": (q_filtered, "select doc_id, md5(coalesce(text, '')) as digest from documents where lang = 'en'"),
    "source_csv": (q_csv, """select item_id, md5('"a", ' || text || chr(10) || 'b"') as digest from benchmark"""),
    "source_verdicts_tsv": (q_verdicts, "select 'span' as kind, case when quality = 1 then 'ok' else 'not_pii' end as verdict, count(*) as n from labels group by all union all select 'missed', 'CITY', count(*) from labels where toxic = 1 having count(*) > 0"),
    "source_predictions": (q_predictions, f"with {FOUND} select 'all' as tag, 'en' as testset, (select count(*) from docs) as n_docs, count(*) as n_spans from found union all select 'emails', 'en', (select count(*) from docs), count(*) filter (label = 'EMAIL') from found"),
    "source_raw_log": (q_raw_log, "select len(coalesce(text, '')) > 1000 as truncated, count(*) as n, cast(sum(len(coalesce(text, ''))) as bigint) as chars, 0 as n_dropped from documents group by 1"),
    "source_zip_json": (q_zip, _BENCH),
    "source_gzip_json": (q_gzip, _BENCH),
    "source_literal_columns": (q_literals, "select doc_id, case when doc_id % 3 <> 0 then len(lang) end as literal_end, case when doc_id % 3 <> 0 then lang end as literal_text, lang as json_text from documents where lang is not null"),
    "source_catalogue": (q_catalogue, f"with {FOUND} select false as checked, case when label in ('IBAN', 'IPADDRESS') then 'IGNORE' else label end as label, count(*) as n from found group by all union all select true, label, count(*) from found group by label"),
    "source_results_glob": (q_results, "select source as tag, lang as testset, round(count(*) / 1000, 6) as leakage_chars, count(*) as items, 1 as dropped_items, cast(sum(len(coalesce(text, ''))) as double) as chars_per_s from documents where source in ('src1', 'src2') group by source, lang"),
    "source_run_list": (q_runs, "select n_name as tag, 'a=' || n_nationkey as overrides, 2 as n_sets from (select *, row_number() over (order by n_nationkey) - 1 as k from nation) where k % 3 = 1 and n_nationkey % 2 <> 0"),
    "source_label_map_yaml": (q_yaml, f"with {FOUND} select case when label in ('EMAIL', 'TELEPHONENUM') then 'CONTACT' else 'IGNORE' end as label, count(*) as n from found group by 1"),
    "source_statistics_upsert": (q_statistics_file, "select lang, case when lang = 'en' then 2 else 1 end * count(*) as n from documents where lang is not null group by lang"),
    "source_raw_rows": (q_restored_emails, f"with {FOUND}, per as (select doc_id, count(*) as n from found where label = 'EMAIL' group by doc_id) select cast(d.doc_id as varchar) as id, case when d.doc_id % 4 = 0 then 0 else coalesce(n, 0) end as n_spans, case when d.doc_id % 4 = 0 then coalesce(n, 0) else 0 end as n_errors, source as region from docs d left join per using (doc_id)"),
}
