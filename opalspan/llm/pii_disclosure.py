"""Personal data: base patterns, and terms that the corpus shows to reveal them (information-theoretic sanitisation)."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
#: A term reveals an entity if they share so many different contexts, if no more bits than REMAINING are left of the
#: entity once the term is known, and if the term tells at least GAIN bits about it. These are bounds of evidence, not
#: shares of what the corpus's size gives: they mean the same in 1,000 texts and in 10^9.
SUPPORT, REMAINING, GAIN = 3, 1.0, 1.0
#: What is left is judged by the lower end of the interval of P(e | t), one-sided, at this many standard deviations.
DEVIATIONS = 1.645
#: Words of a batch of contexts, but for the last text's.
BATCH_WORDS = 100_000
#: A word in more than one of so many different texts is frequent.
FREQUENT = 100
#: Revealing terms of so many characters or more are generalised to what they are of, shorter ones removed.
GENERALISE_FROM = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")
#: Words are runs of letters, cut by the same class here and in SQL, where they are also put into lower case.
_WORD = regex.compile(r"\p{L}{2,}")
_NO_WORD = r"[^\p{L}]+"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, by walking from one @ to the next: the local part is the run before it, so no run is tried
    from each of its characters."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    found += [("ip", *x) for x in ips(text)] if "." in text else []
    found += [("card", *x) for x in cards(text)]
    if "+" in text:
        found += [("phone", *x) for x in phones(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """All words of the text that are not in an entity: the context of each of its entities."""
    rest = sorted((s, e) for _, s, e in spans)
    at, upto = 0, 0  # spans that start before the word's end, and how far they reach
    for m in _WORD.finditer(text):
        s, e = m.span()
        while at < len(rest) and rest[at][0] < e:
            upto = max(upto, rest[at][1])
            at += 1
        if upto <= s:
            yield m[0], s, e


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    out = {}
    for kind, s, e in spans:
        value = text[s:e].lower() if kind == "email" else _DIGIT.sub("", text[s:e]) if kind != "ip" else text[s:e]
        out[xxhash.xxh3_64_intdigest(f"{kind}:{value}") - 2**63] = kind
    return [{"kind": k, "entity": e} for e, k in out.items()]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.int64())]))
_SPANS_SQL = "array<struct<kind:string,s:int,e:int>>"
_CONTEXT_SQL = "entities array<struct<kind:string,entity:bigint>>, context long, words array<struct<term:string,s:int,e:int>>"


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        ends, terms, starts, stops = [0], [], array("i"), array("i")

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), _SPANS, _ENTITIES, pa.int64())
            flat = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(np.frombuffer(starts, np.int32)), pa.array(np.frombuffer(stops, np.int32))], ["term", "s", "e"])
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(rows, types)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "tkey", "base", "entities", "context", "words"])

        for d, t, key in zip(*(b.column(i).to_pylist() for i in range(3))):
            text = t or ""
            found = base_spans(text)
            hashed = xxhash.xxh3_64()
            for term, s, e in _words(text, found) if found else ():
                terms.append(term)
                starts.append(s)
                stops.append(e)
                hashed.update(f"{term.lower()} ")
            some = len(terms) > ends[-1]
            ends.append(len(terms))
            for c, x in zip(rows, (d, key, [{"kind": k, "s": s, "e": e} for k, s, e in found], _entities(text, found) if some else [], hashed.intdigest() - 2**63)):
                c.append(x)
            if len(terms) > BATCH_WORDS:
                yield out()
                rows, ends, terms, starts, stops = [[], [], [], [], []], [0], [], array("i"), array("i")
        if rows[0]:
            yield out()


def least_share(k: Column, n: Column) -> Column:
    """Lower end of Wilson's interval of k out of n."""
    z2, p = DEVIATIONS**2, k / n
    return (p + z2 / (2 * n) - DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def revealing_terms(found: DataFrame, texts: DataFrame, docs: DataFrame, support: int = SUPPORT, remaining: float = REMAINING, gain: float = GAIN) -> DataFrame:
    """(tkey, kind, term): terms of each text that disclose one of its entities; of several kinds the first by name.

    Counts are of different texts, wherever the words stand: n_e with the entity, n_t with the term, n_et with both. Of the
    entity's information, -log2 P(e), the term leaves -log2 P(e | t), with P(e | t) at the lower end of its interval for
    n_et of n_t; the difference, their pointwise mutual information, is what it tells. It reveals if at least `support`
    different contexts have both, `remaining` bits or fewer are left, and `gain` or more are told. So a word that stands
    once beside an entity proves nothing, in however many texts, and neither does an entity met in fewer contexts.

    P(e | t) is at most n_e / n_t, so only terms in up to n_e * 2^remaining texts are paired with an entity.
    """
    uses = texts.select("tkey", "context", F.explode("entities").alias("x")).select("tkey", "context", "x.kind", "x.entity")
    known = uses.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support)
    total = found.select("tkey").distinct().agg(F.count(F.lit(1)).alias("n"))
    known = known.crossJoin(F.broadcast(total)).select("entity", "n_e", "n", (F.col("n_e") * 2**remaining).alias("most"))
    uses = written(uses.join(known, "entity"), "uses")
    if uses.isEmpty():
        return uses.select("tkey", "kind", F.lit("").alias("term"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), _NO_WORD), lambda w: F.length(w) > 1))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    copied = written(rows.groupBy("own").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copied")
    side = F.broadcast(copied) if copied.count() <= FEW else copied
    # each copy of a text counts its share of one text
    share = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    every = rows.join(side, "own", "left").select(share.alias("share"), F.explode(words).alias("term")).groupBy("term").agg(F.round(F.sum("share")).alias("n_t"))
    # words of very many texts are sent to the texts, as all their rows would meet in one task; by their definition
    # they are few
    highest = texts.select("tkey", F.explode(F.array_distinct(F.transform("words", lambda w: F.lower(w["term"])))).alias("term")).join(uses.groupBy("tkey").agg(F.max("most").alias("highest")), "tkey")
    every = written(every.crossJoin(F.broadcast(total)).select("term", "n_t", (F.col("n_t") * FREQUENT > F.col("n")).alias("often")), "terms")
    often = every.where("often").select("term", F.col("n_t").alias("n_often"))
    side = highest.join(F.broadcast(often) if often.count() <= FEW else often, "term", "left")
    common = side.where("n_often <= highest").select("tkey", "term", F.col("n_often").alias("n_t"))
    scarce = side.where("n_often is null").join(every.where("not often"), "term").where("n_t <= highest").select("tkey", "term", "n_t")
    pairs = written(common.unionByName(scarce).join(uses, "tkey").where("n_t <= most"), "pairs")
    seen = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.countDistinct("context").alias("k"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("n").alias("n"))
    left = -F.log2(least_share(F.col("n_et"), F.col("n_t")))
    told = F.log2(F.col("n") / F.col("n_e")) - left
    good = seen.where((F.col("k") >= support) & (left <= remaining) & (told >= gain)).select("entity", "term")
    return pairs.select("tkey", "kind", "entity", "term").join(good, ["entity", "term"], "left_semi").groupBy("tkey", "term").agg(F.min("kind").alias("kind"))


def _text_key() -> Column:
    """The key of equal texts, null and empty ones alike. Spark computes it: a Python function for it beside another in
    one stage takes two Python workers a task, and an executor keeps them all."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tkey")


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, base, entities, context, words) of each row, written: base spans and, where there are some, what
    they name and the words of the whole text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key())
    return written(texts.mapInArrow(_detect, f"doc_id long, tkey long, base {_SPANS_SQL}, {_CONTEXT_SQL}"), "personal")


def term_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(tkey, terms): spans of the words of each text that reveal one of its entities, wherever they stand, with the kind
    of that; of several kinds the first by name."""
    texts = written(found.where(F.size("entities") > 0).select("tkey", "entities", "context", "words").dropDuplicates(["tkey"]), "contexts")
    words = texts.select("tkey", F.explode("words").alias("w")).select("tkey", F.lower("w.term").alias("term"), "w.s", "w.e")
    shown = words.join(revealing_terms(found, texts, docs), ["tkey", "term"])
    return shown.groupBy("tkey").agg(F.collect_list(F.struct("s", "e", "kind")).alias("terms"))


def _written_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for d, k, base, terms in zip(*(b.column(i).to_pylist() for i in range(4))):
            own = [(x["kind"], x["s"], x["e"]) for x in base]
            more = sorted({("term", x["s"], x["e"]) for x in terms or []})
            whole = sorted([*own, *more], key=lambda x: (x[1], order[x[0]]))
            text = lambda spans: ",".join(f"{a}:{s}:{e}" for a, s, e in spans)
            values = (d, k, *(sum(x[0] == kind for x in own) for kind in KINDS), hashlib.sha256(text(own).encode()).hexdigest(), text(whole))
            for c, x in zip(out, values):
                c.append(x)
        types = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "tkey", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs.

    Base spans are leftmost non-overlapping matches per kind, those failing their test dropped. Terms that reveal an
    entity, by the same bounds of evidence at every size of the corpus, are added as spans of kind `term` wherever they
    stand in a text with that entity. A null text is empty and
    has none; a repeated row gets equal spans, and equal texts count as one document of evidence; an empty table
    gives no rows. Texts are read once to detect and, if any has an entity, once more to count words; only words of
    texts with entities are shuffled.
    """
    found = detected(docs)
    terms = term_spans(found, docs)
    both = found.select("doc_id", "tkey", "base").join(terms, "tkey", "left").select("doc_id", "tkey", "base", "terms")
    return both.mapInArrow(_written_spans, "doc_id long, tkey long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """text with base spans as [KIND], and revealing terms removed or generalised to [KIND TERM], a class that all terms
    share that reveal something of the kind; of overlapping spans the first stays."""
    out, at = [], 0
    for kind, s, e, of in spans:
        if s < at:
            if e <= at:
                continue
            s = at
        out.append(text[at:s])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif e - s >= GENERALISE_FROM:
            out.append(f"[{of.upper()} TERM]")
        at = e
    return "".join([*out, text[at:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    for b in batches:
        out = []
        for t, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            text = t or ""
            spans = [*((*x, "") for x in base_spans(text)), *(("term", x["s"], x["e"], x["kind"]) for x in terms or [])]
            out.append(sanitised(text, sorted(spans, key=lambda x: (x[1], order[x[0]], x[2]))))
        yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["row", "text"])


#: Texts with revealing terms, copied texts and frequent words up to which they are broadcast; beyond that the texts, or
#: their words, are shuffled to them.
FEW = 20_000


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data masked and revealing terms generalised or removed; every row and column stays. A null
    text becomes empty. Base spans are found again beside the text; only revealing terms are joined to it."""
    found = detected(docs)
    terms = written(term_spans(found, docs), "terms")
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"), _text_key())
    kind = rows.schema["row"].dataType.simpleString()
    side = F.broadcast(terms) if terms.count() <= FEW else terms
    keyed = rows.join(side, "tkey", "left").select("row", "text", "terms")
    return keyed.mapInArrow(_sanitise, f"row {kind}, text string").select("row.*", "text").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_spans(docs).drop("tkey")
