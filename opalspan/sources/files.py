"""Reading and writing of examples, predictions, configurations and results."""

from __future__ import annotations

import ast
import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.functions.spans import EXAMPLE, SPANS, resliced

PREDICTION = f"id string, pred {SPANS}"
RAW_LOG = "id string, offset int, chunk_len int, raw string, valid_json boolean, truncated boolean, dropped array<struct<label:string,text:string,reason:string>>"


def read_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines; unknown keys are ignored, meta defaults to none, span texts come from offsets. limit counts lines,
    blank ones too."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit is not None else lines
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", EXAMPLE).alias("r")).select("r.*")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    gold = F.transform(spans, lambda s: s.withField("source", F.coalesce(s["source"], F.lit("gold"))))
    return rows.select("id", "text", resliced(F.col("text"), gold).alias("spans"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))


def example_json() -> Column:
    """A row as a JSON line: of a span only start, end and label."""
    spans = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["label"]))
    return F.to_json(F.struct("id", "text", spans.alias("spans"), "meta"))


def write_examples(df: DataFrame, path: str) -> None:
    df.select(example_json().alias("value")).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def write_predictions(df: DataFrame, path: str, tag: str, testset: str) -> None:
    """Under tag and testset as partitions."""
    df.select("id", "pred", F.lit(tag).alias("tag"), F.lit(testset).alias("testset")).write.mode("append").partitionBy("tag", "testset").json(path)


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOG).json(path)


def read_filtered(spark: SparkSession, path: str, schema: str, language: str) -> DataFrame:
    """Raw JSON lines of a language: a pattern on the line first, then the parsed value."""
    near = F.col("value").rlike(r'"language"\s*:\s*"' + re.escape(language) + '"')
    return spark.read.text(path).where(near).select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col("language") == language)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def answered(df: DataFrame, *columns: str) -> bool:
    """Whether any row has a non-blank answer: such a sheet must not be overwritten."""
    test = F.lit(False)
    for c in columns:
        test = test | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return not df.where(test).limit(1).isEmpty()


def read_verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tab-separated sheet with # comments -> (verdicts of spans, missed values)."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema("doc int, span string, verdict string, correct string, note string").csv(path)
    spans = rows.where("span <> 'MISSED'").withColumn("span", F.col("span").cast("int"))
    return spans, rows.where("span = 'MISSED'").select("doc", F.col("verdict").alias("value"), F.col("correct").alias("label"), "note")


def read_zip_json(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of a JSON list in a member of zip archives; each archive is read by one task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = json.loads(zipfile.ZipFile(io.BytesIO(content)).read(member))
                yield pd.DataFrame({"value": [json.dumps(r) for r in rows]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unpack, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_gzip_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


LITERAL_SPANS = "array<struct<start:int,end:int,label:string,text:string>>"


def _literal(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(ast.literal_eval(v))
        except (ValueError, SyntaxError):
            return None

    return values.map(one)


def literal_column(column: Column, schema: str = LITERAL_SPANS) -> Column:
    """A Python literal: None, True and single quotes are allowed; null if it does not parse."""
    return F.from_json(F.pandas_udf(_literal, "string")(column), schema)


def json_column(column: Column, schema: str = LITERAL_SPANS) -> Column:
    return F.from_json(column, schema)


def label_map(text: str) -> dict[str, str]:
    """From YAML: the mapping, or the one under `labels`."""
    given = yaml.safe_load(text) or {}
    return dict(given.get("labels", given))


def read_label_map(path: str) -> dict[str, str]:
    return label_map(Path(path).read_text())


class Catalogue:
    """Names of test sets; an unknown name is a path."""

    def __init__(self, sets: dict[str, str]) -> None:
        self.sets = dict(sets)

    def path(self, name: str) -> str:
        return self.sets.get(name, name)

    def load(self, spark: SparkSession, name: str, limit: int | None = None, checked: bool = False) -> DataFrame:
        """The set with unique ids, IBAN and IPADDRESS out of scope unless asked for."""
        from opalspan.operators.prep import evaluation_scope, repeated_ids

        df = read_examples(spark, self.path(name), limit)
        twice = [r["id"] for r in repeated_ids(df).limit(5).collect()]
        if twice:
            raise ValueError(f"{name}: repeated ids {twice}")
        return evaluation_scope(df, checked)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files named system__testset.json that have a latency; nested metrics flattened."""
    schema = "metrics struct<leakage_chars:double,over_redaction:double,llm_output:struct<items:long,dropped_items:long,outputs:long,truncated:long>>, latency struct<p50_ms_per_1k_chars:double,p95_ms_per_1k_chars:double,chars_per_s:double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    out = rows.where("latency is not null").withColumns({"tag": F.split(name, "__")[0], "testset": F.split(name, "__")[1]})
    return out.select("tag", "testset", "metrics.leakage_chars", "metrics.over_redaction", "metrics.llm_output.*", F.col("latency.chars_per_s").alias("chars_per_s"))


def read_runs(spark: SparkSession, path: str, shard: int = 0, of: int = 1) -> DataFrame:
    """Lines 'tag | config | overrides | sets' without # comments, dealt round-robin to shards."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> '' and not ltrim(value) like '#%'")
    part = F.split("value", r"\|")
    named = rows.select("line", *[F.trim(F.get(part, i)).alias(n) for i, n in enumerate(("tag", "config", "overrides", "sets"))])
    # a run list is a hand-written file: its lines are numbered in one task
    from pyspark.sql import Window

    ranked = named.withColumn("k", F.row_number().over(Window.orderBy("line")) - 1)
    return ranked.where(F.col("k") % of == shard).select("k", "tag", "config", "overrides", F.split("sets", r"[\s,]+").alias("sets"))


def pending_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs of which some result is missing."""
    wanted = runs.select("tag", F.explode("sets").alias("testset"))
    return runs.join(wanted.join(results.select("tag", "testset"), ["tag", "testset"], "left_anti").select("tag").distinct(), "tag", "left_semi")


def updated_json(text: str, new: dict) -> str:
    """A JSON mapping with new keys merged in; the last wins. An empty text is an empty mapping."""
    return json.dumps((json.loads(text) if text else {}) | new, indent=2, ensure_ascii=False)


def updated_statistics(path: str, new: dict) -> dict:
    """The same for a file."""
    file = Path(path)
    file.write_text(updated_json(file.read_text() if file.exists() else "", new))
    return json.loads(file.read_text())


def with_overrides(config: dict, overrides: list[str]) -> dict:
    """config with dotted keys set: 'a.b=3' parses 3 as YAML; an unknown key is an error."""
    out = json.loads(json.dumps(config))
    for o in overrides:
        key, _, value = o.partition("=")
        *above, last = key.split(".")
        at = out
        for k in above:
            at = at[k]
        if last not in at:
            raise KeyError(key)
        at[last] = yaml.safe_load(value)
    return out


def markdown(df: DataFrame) -> str:
    """A small result as a table; nulls are blank."""
    head = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join([*head, *(f"| {' | '.join(map(cell, r))} |" for r in df.collect())])


def replaced_block(document: str, name: str, content: str) -> str:
    """document with what stands between the markers of a block replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    a, b = document.index(start) + len(start), document.index(end)
    return f"{document[:a]}\n{content}\n{document[b:]}"
