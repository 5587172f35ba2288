"""Quality rules over lines and words, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line is common above this share of its host's different texts, at every size; a line in LINE_FLOOR texts or fewer
#: never is, as so few say nothing.
LINE_SHARE, LINE_FLOOR = 0.05, 2
#: A document whose lines above the limit hold more than this share of its words is rejected.
DEPLETED_SHARE = 0.8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row: a lambda's variable is bound, a repeated expression may be inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != F.lit(""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text, the first occurrence included.

    Windows are hashed from the words' hashes and sorted with their places; neighbours with equal hashes repeat. The
    places of repeated windows, sorted again, cover each the words up to the next place or the window's end.
    """

    def places(hashed: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(hashed) - (window - 1))
        key = lambda i: F.xxhash64(*[F.get(hashed, i - 1 + k) for k in range(window)])
        return F.transform(spots, lambda i: F.struct(key(i).alias("h"), i.alias("i")))

    def repeats(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        twin = lambda x, k: (x["h"] == h(k + 1)) | (x["h"] == h(k - 1))
        hit = F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(twin(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull())
        return F.array_sort(hit)

    def covered(i: Column) -> Column:
        step = lambda x, k: F.least(F.lit(window), F.coalesce(F.get(i, k + 1) - x, F.lit(window)))
        return F.aggregate(F.transform(i, step), F.lit(0).cast("long"), lambda a, x: a + x)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    count = lambda w: _let(_let(F.array_sort(places(w)), repeats), covered)
    return _let(hashed, lambda w: F.when(F.size(w) >= window, count(w)).otherwise(F.lit(0).cast("long")))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACE, " "))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _keyed(docs: DataFrame) -> DataFrame:
    text, host = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    return docs.withColumns({"_ol_text": text, "_ol_host": host, "_ol_key": F.xxhash64(host, text)})


def common_lines(docs: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR) -> DataFrame:
    """(_ol_host, _ol_key, line, words): lines above their host's limit, once for each different text that has them, with
    the words of all their occurrences there."""
    places = F.transform(_lines(F.col("_ol_text")), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).alias("words")))
    keyed = _keyed(docs).select("_ol_host", "_ol_key", places.alias("p")).dropDuplicates(["_ol_host", "_ol_key"])
    own = keyed.select("_ol_host", "_ol_key", F.explode("p").alias("x")).groupBy("_ol_host", "_ol_key", "x.line").agg(F.sum("x.words").alias("words"))
    texts = _keyed(docs).select("_ol_host", "_ol_key").distinct().groupBy("_ol_host").agg(F.greatest(F.lit(float(floor)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    counted = own.groupBy("_ol_host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    common = counted.join(texts, "_ol_host").where(F.col("n") > F.col("limit")).select("_ol_host", "line")
    return own.join(common, ["_ol_host", "line"], "left_semi")


def assess(docs: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR, depleted: float = DEPLETED_SHARE) -> DataFrame:
    """Every row of docs with all its columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_common_words (words on lines above the host's limit, every occurrence), kept.

    A line counts once for each different text of a host (source), so exact copies do not make their own lines
    common; its limit is `share` of the host's different texts, and more than `floor` must have it. kept: not base_failed, and neither
    over `depleted` of the words on such lines nor fewer than MIN_WORDS left without them. A null text has no words
    and fails; a null source is a host of its own; repeated rows get equal verdicts; columns named like the new ones
    are replaced. Only hashes and counts are shuffled, lines pre-aggregated; texts are shuffled only where kept.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept"]
    keyed, text = _keyed(docs.drop(*new)), F.col("_ol_text")
    words = words_of(text)
    base = keyed.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in new],
        "_ol_key",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    )
    hit = common_lines(docs, share, floor).groupBy("_ol_key").agg(F.sum("words").alias("n_common_words"))
    out = base.join(hit, "_ol_key", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long"))).drop("_ol_key")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    worn = (F.col("n_common_words") > depleted * F.col("n_words")) | ((F.col("n_common_words") > 0) & (left < MIN_WORDS))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~worn)


def without_common_lines(docs: DataFrame, share: float = LINE_SHARE, floor: int = LINE_FLOOR) -> DataFrame:
    """docs with the lines above their host's limit taken out of text; a null text becomes empty."""
    hit = common_lines(docs, share, floor).groupBy("_ol_key").agg(F.collect_set("line").alias("_ol_lines"))
    gone = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(F.col("_ol_lines"), F.xxhash64(normalised(x)))
    rest = F.array_join(F.filter(F.split("_ol_text", "\n", -1), lambda x: ~gone(x)), "\n")
    out = _keyed(docs).join(hit, "_ol_key", "left")
    return out.withColumn("text", F.when(F.col("_ol_lines").isNull(), F.col("_ol_text")).otherwise(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")
