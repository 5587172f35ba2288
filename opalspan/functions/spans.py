"""Columns over spans: arrays of (start, end, label, text, source, score) with code-point offsets, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,text:string,source:string,score:double>"
SPANS = f"array<{SPAN}>"
EXAMPLE = f"id string, text string, spans {SPANS}, meta map<string,string>"

#: Labels a model is asked for, labels only validators give, and coarse labels of other detectors.
MODEL_LABELS = tuple(
    "GIVENNAME SURNAME TITLE AGE SEX GENDER DATE EMAIL TELEPHONENUM STREET BUILDINGNUM CITY ZIPCODE IDCARDNUM PASSPORTNUM DRIVERLICENSENUM "
    "SOCIALNUM TAXNUM CREDITCARDNUMBER".split()
)
CHECKED_LABELS = ("IBAN", "IPADDRESS")
BUCKETS = ("NAME", "OTHER")
LABELS = MODEL_LABELS + BUCKETS
IGNORE = "IGNORE"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column, text: Column, source: Column | str = "gold", score: Column | None = None) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    score = F.lit(None).cast("double") if score is None else score.cast("double")
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), text.alias("text"), source.alias("source"), score.alias("score"))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substr(text, start + 1, end - start)


def let(value: Column, use) -> Column:
    """use(value) with value bound once: an expression used several times in a lambda would run several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, label: str, source: str = "validator", needs: Column | None = None) -> Column:
    """Spans of the pattern's non-overlapping matches. `needs`: a cheap test that a text with a match passes. Pieces between matches and the matches alternate, so a match
    starts at the summed lengths of what is before it. The pattern must not match the empty string."""
    begin = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["a"])
        end = start + F.length(pair["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span(start, end, F.lit(label), pair["m"], source))).alias("out"))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, m: F.struct(a.alias("a"), m.alias("m")))
    found = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), begin, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern) if needs is None else needs & text.rlike(pattern), found).otherwise(no_spans())


def by_start(spans: Column) -> Column:
    """Sorted by start, then end, then label."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return F.array_sort(spans, order)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))


def resliced(text: Column, spans: Column) -> Column:
    """Each span's text taken from its offsets."""
    return F.transform(spans, lambda s: s.withField("text", cut(text, s["start"], s["end"])))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """(start, end) shrunk off white space at both ends; an all-blank span shrinks to its end."""
    piece = cut(text, start, end)
    lead = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
    tail = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)\s+$", ""))
    blank = lead == F.length(piece)
    return F.struct((start + lead).cast("int").alias("start"), F.when(blank, end).otherwise(end - tail).cast("int").alias("end"))


def span_errors(text: Column, spans: Column) -> Column:
    """One message per bad span: past the end, or a text that differs from the slice."""
    message = lambda s: F.when(s["end"] > F.length(text), F.concat(F.lit("end past text: "), s["label"])).when((F.length(s["text"]) > 0) & (s["text"] != cut(text, s["start"], s["end"])), F.concat(F.lit("text differs: "), s["label"]))
    return F.filter(F.transform(spans, message), lambda e: e.isNotNull())


def in_range(text: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda s: ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))))


def deduped(spans: Column) -> Column:
    """One span per (start, end, label), of highest score, null as 0; the first of equals."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
    value = lambda s: F.coalesce(s["score"], F.lit(0.0))
    beaten = lambda s, i: F.exists(F.transform(spans, lambda o, k: F.struct(o.alias("o"), k.alias("k"))), lambda x: same(x["o"], s) & ((value(x["o"]) > value(s)) | ((value(x["o"]) == value(s)) & (x["k"] < i))))
    return F.filter(spans, lambda s, i: ~beaten(s, i))


def positions(spans: Column) -> Column:
    """Code points that spans cover, each once."""
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.sequence(s["start"], s["end"] - 1))))


def mapped_labels(spans: Column, mapping: dict[str, str], default: str = IGNORE) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    return F.transform(spans, lambda s: s.withField("label", F.coalesce(F.try_element_at(table, s["label"]), F.lit(default))))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with each span replaced by by(span), left to right; a span that starts inside an earlier one is skipped."""
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        later = F.struct(s["end"].alias("pos"), F.concat(acc["out"], cut(text, acc["pos"], s["start"]), by(s)).alias("out"))
        return F.when(s["start"] < acc["pos"], acc).otherwise(later)

    return F.aggregate(by_start(spans), begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.length(text))))


def masked(text: Column, spans: Column) -> Column:
    return replaced(text, spans, lambda s: F.concat(F.lit("["), s["label"], F.lit("]")))


def inline_masked(text: Column, spans: Column) -> Column:
    return replaced(text, spans, lambda s: F.concat(F.lit("["), s["label"], F.lit(": "), cut(text, s["start"], s["end"]), F.lit("]")))


def context(text: Column, s: Column, reach: int = 60) -> Column:
    """...left«value»right... on one line."""
    left, right = cut(text, F.greatest(F.lit(0), s["start"] - reach), s["start"]), cut(text, s["end"], s["end"] + reach)
    return F.translate(F.concat(F.lit("…"), left, F.lit("«"), cut(text, s["start"], s["end"]), F.lit("»"), right, F.lit("…")), "\n", " ")


def highlights(text: Column, spans: Column) -> Column:
    """The text in order as (segment, label): label null between spans; empty segments are left out."""
    part = lambda t, lab: F.struct(t.alias("segment"), lab.cast("string").alias("label"))
    kind = "array<struct<segment:string,label:string>>"
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(part(cut(text, acc["pos"], s["start"]), F.lit(None)), part(cut(text, s["start"], s["end"]), s["label"]))).alias("out"))
    whole = F.aggregate(by_start(spans), begin, step, lambda acc: F.concat(acc["out"], F.array(part(F.substr(text, acc["pos"] + 1, F.length(text)), F.lit(None)))))
    return F.filter(whole, lambda x: F.length(x["segment"]) > 0)


def exploded(df: DataFrame, column: str = "spans", *keys: str) -> DataFrame:
    """The relation of spans: keys, ord, and the span's fields."""
    return df.select(*keys, F.posexplode(column).alias("ord", "s")).select(*keys, "ord", "s.*")


def collected(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(by_start(F.collect_list(span(F.col("start"), F.col("end"), F.col("label"), F.col("text"), F.col("source"), F.col("score")))).alias("spans"))
