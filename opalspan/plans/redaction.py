"""Whole redaction: normalise, detect, merge, apply a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalspan.functions.detect import validators
from opalspan.functions.policy import Policy, entities, redacted
from opalspan.functions.spans import SPANS
from opalspan.functions.text import normalised, spans_to_original
from opalspan.operators.merge import recall_first_union

#: Characters of a text and messages of a request at most.
MAX_TEXT, MAX_MESSAGES = 100_000, 100


def detect(df: DataFrame, model: str | None = None, normalise: bool = True, detector=validators) -> DataFrame:
    """df(text) with spans: the detector on normalised text, its spans moved back, and the spans of the column `model`
    merged into them. A null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if normalise:
        out = df.withColumn("_n", normalised(text)).withColumn("_found", detector(F.col("_n.text"))).withColumn("_found", spans_to_original(text, F.col("_n.origin"), F.col("_found"))).drop("_n")
    else:
        out = df.withColumn("_found", detector(text))
    groups = [F.col("_found")] + ([F.coalesce(F.col(model), F.array().cast(SPANS)).cast(SPANS)] if model else [])
    return out.withColumn("spans", recall_first_union(text, *groups)).drop("_found")


def redact(df: DataFrame, policy: Policy, model: str | None = None, hash_key: bytes | None = None, limit: int | None = MAX_TEXT) -> DataFrame:
    """df(text) with redacted, entities and error. It fails closed: a text over the limit is null with an error, never
    itself; without a limit every text is redacted."""
    found = detect(df, model)
    text = F.coalesce(F.col("text"), F.lit(""))
    long = F.length(text) > limit if limit else F.lit(False)
    out = found.withColumn("error", F.when(long, "text_too_long")).withColumn("redacted", F.when(~long, redacted(text, F.col("spans"), policy, hash_key=hash_key)))
    return out.withColumn("entities", F.when(~long, entities(F.col("spans"), policy)))


def refused(messages: DataFrame, most: int = MAX_MESSAGES, longest: int = MAX_TEXT) -> DataFrame:
    """(tenant, conversation, error) of requests over a limit: too many messages, or one that is too long."""
    sizes = messages.groupBy("tenant", "conversation").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("size"))
    error = F.when(F.col("n") > most, "too_many_messages").when(F.col("size") > longest, "text_too_long")
    return sizes.select("tenant", "conversation", error.alias("error")).where("error is not null")


def degraded(model_spans, validator_spans) -> tuple:
    """(spans, detector_used) of a page that says when a model failed and validators stood in."""
    return F.coalesce(model_spans, validator_spans), F.when(model_spans.isNull(), "validators").otherwise("model")
