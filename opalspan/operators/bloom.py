"""A blocked Bloom filter as a column: keys that are certainly not in a set go before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalspan.functions.text import word_ngrams, word_tokens

#: Bits for a key, and 64-bit words of a filter at most: 8 MB, whatever the set's size. A fuller filter lets more through.
BITS, MOST_WORDS = 16, 1 << 20


def _mask(h: Column) -> Column:
    """Three bits of a key's word."""
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, by).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def built(keys: DataFrame, key: str, most: int = MOST_WORDS) -> DataFrame:
    """keys(key long) -> one row (_bloom array<long>), of a size that the number of keys gives, up to `most` words. Words
    are put together in tasks by their number; only they reach the row."""
    n = keys.select(key).distinct().count()
    words = min(most, max(1, -(-n * BITS // 64)))
    h = F.col(key)
    filled = keys.select(F.pmod(F.shiftright(h, 18), F.lit(words)).cast("int").alias("at"), _mask(h).alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left").select("at", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mask"))), lambda x: x["mask"]).alias("_bloom"))


def may_hold(bloom: Column, h: Column) -> Column:
    """False only for keys that are not in the filter's set."""
    word = F.get(bloom, F.pmod(F.shiftright(h, 18), F.size(bloom)).cast("int"))
    return word.bitwiseAND(_mask(h)) == _mask(h)


def contaminated(docs: DataFrame, evaluation: DataFrame, n: int = 8, key: str = "doc_id", most: int = MOST_WORDS) -> DataFrame:
    """Keys of docs(key, text) that share an n-gram of words with evaluation(text); exact.

    Every n-gram of every document is tried against a filter of the evaluation's, in the task that made it. What passes,
    the shared ones and a few besides, is shuffled and joined to the n-grams themselves. Null texts have none.
    """
    grams = lambda: word_ngrams(word_tokens(F.coalesce(F.col("text"), F.lit(""))), n)
    known = evaluation.select(F.explode(grams()).alias("gram")).distinct()
    bloom = built(known.select(F.xxhash64("gram").alias("h")), "h", most)
    # one row of `most` words at most
    tried = docs.select(F.col(key), "text").crossJoin(F.broadcast(bloom))
    left = tried.select(key, F.explode(F.filter(grams(), lambda g: may_hold(F.col("_bloom"), F.xxhash64(g)))).alias("gram"))
    return left.join(known, "gram", "left_semi").select(key).distinct()
