"""Rules over labelled documents: label noise, record checks, acceptance of generated messages, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalspan.functions.spans import LABELS, MODEL_LABELS, cut, let, matches, positions
from opalspan.functions.text import word_ngrams, word_tokens

#: Words and signs around a span that show it is no person's data.
MONEY_BEFORE = (
    r"[$£€]\s*$|(\b(funds?|fund of|funding of|rent of|deposit of|value of|up to|over|balance|contribution|credit line of|reimbursement of|fee|"
    r"allocated|covers|total|amount|cost|price|salary|budget|pledge|grant)\b[^.\n]{0,20})$"
)
MONEY_AFTER = r"^\s*(per (month|year|week)|fee|balance|million|thousand)\b"
CARD_CUE = r"\b(via|card|ending in|ending|charged to|number|no\.?|using|with)\s*:?\s*$"
AGE_AFTER = r"^\s*(%|percent|\s*%|\+?\s*years? of experience|-?\s*year[- ]milestone|minutes|hours|million|out of|°|x\b|cm\b|kg\b)"
PEOPLE = (
    r"(participants|members|residents|employees|patients|users|individuals|adults|children|students|people|travell?ers|guests|volunteers|founders|"
    r"consumers|engineers|men|women|females|males|seniors|those|anyone|staff|contributors|applicants|customers|clients)"
)
AGE_BEFORE = (
    r"(\baverage( age)?( of)?|\b" + PEOPLE + r"\s+aged|\bunder|\bover|\bat least|\branging( in age)? from|\bfrom ages?|\bages|\brate of|"
    r"\bscore of|\bnumber of [a-z]+:?|\bincreased by|\bdecreased by|\bdropped to|\bby roughly|\bages?\s+between|\bexperience \(years\):?\s*_*|\bboth\b[^.]{0,10})\s*\(?$"
)
AGE_RANGE = r"^\s*([–-]|to)\s*\d|^\s*and (older|above|over)\b"
AGE_RANGE_END = r"\d\s*([–-]|to)\s*$"
GROUP_BEFORE = r"\b(ratio|distribution|split|all|categories of|irrespective of|regardless of|source of|demographics?|identities|analysts?)\s*\(?$"
GROUP_AFTER = r"^\s*(analysts|identities|demographics|data|out of|existence)\b"
REFERENCE_AFTER = r"^\s*(regulations?|compliance|requirements?|fee structure|entries|fields)\b"
COMPANY_PHONE = r"(?i)\b(?:call|reach|contact|ring|phone|text)\s+us\b|\bus (?:at|on)\b|\bour (?:number|line|helpline|team)\b"
HEADER_DATE = r"(?:Sent|Date|Dated|dated|Received|Posted)\s*:?\s*$"
TITLE_NAME = r"\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Rev|Capt|Sgt|Sir|Dame)\.?\s+[A-Z][a-z]+"
DIGIT_RUN = r"\d(?:[\d \-./]*\d)?"
EMAILISH = r"[\w.+-]+@[\w-]+\.[\w.]+|\b\w+ at \w+ dot \w+"
WORDLIKE = ("may", "long", "will", "mark", "grace", "rose", "hope", "art", "bill", "dawn", "faith", "joy", "summer", "young", "west")
MAX_CHARS = 2000


def before(text: Column, s: Column, n: int = 30) -> Column:
    return F.lower(cut(text, F.greatest(F.lit(0), s["start"] - n), s["start"]))


def after(text: Column, s: Column, n: int = 30) -> Column:
    return F.lower(cut(text, s["end"], s["end"] + n))


def _for(s: Column, labels: tuple[str, ...], test: Column) -> Column:
    """The label decides first; CASE keeps patterns from running on other labels."""
    return F.when(s["label"].isin(*labels), test).otherwise(False)


#: Noise rules by name: (text, span) -> the span is probably no person's data.
RULES = {
    "money_as_card": lambda t, s: _for(s, ("CREDITCARDNUMBER",), ~before(t, s).rlike(CARD_CUE) & (before(t, s).rlike(MONEY_BEFORE) | after(t, s).rlike(MONEY_AFTER))),
    "age_not_a_person": lambda t, s: _for(s, ("AGE",), after(t, s).rlike(AGE_AFTER) | before(t, s).rlike(AGE_BEFORE) | after(t, s).rlike(AGE_RANGE) | before(t, s).rlike(AGE_RANGE_END)),
    "group_attribute": lambda t, s: _for(s, ("GENDER", "SEX"), before(t, s, 25).rlike(GROUP_BEFORE) | after(t, s).rlike(GROUP_AFTER)),
    "reference_not_id": lambda t, s: _for(s, ("TAXNUM", "SOCIALNUM", "ZIPCODE", "CREDITCARDNUMBER"), after(t, s).rlike(REFERENCE_AFTER)),
}


def noise(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rule, start, end, label): spans that a rule takes for noise."""
    names = lambda s: F.filter(F.array(*[F.when(rule(F.col("text"), s), F.lit(n)) for n, rule in RULES.items()]), lambda x: x.isNotNull())
    hits = df.select(key, F.explode(F.filter(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), names(s).alias("rules"))), lambda x: F.size(x["rules"]) > 0)).alias("x"))
    return hits.select(key, F.explode("x.rules").alias("rule"), "x.start", "x.end", "x.label")


def without_noise(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without any flagged span: a wrong rule costs data, a relabelled span would teach a leak."""
    flagged = F.exists("spans", lambda s: F.exists(F.array(*[rule(F.col("text"), s) for rule in RULES.values()]), lambda x: x))
    return df.where(~flagged)


def cleaned(df: DataFrame, order: list[str], sizes: tuple[int, ...], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, report) of documents in a total order: kept are those without any flagged span, with rank from 1; report is
    (name, n): the pool, kept and dropped documents, flags by rule, and how many of the first n kept make each size. Ranks
    are running counts over ranges of the order, so no task ranks them all."""
    from opalspan.operators.ordered import before as earlier

    flagged = df.withColumn("_flags", F.flatten(F.transform("spans", lambda s: F.filter(F.array(*[F.when(rule(F.col("text"), s), F.lit(n)) for n, rule in RULES.items()]), lambda x: x.isNotNull()))))
    counts = flagged.select(F.explode(F.concat(F.array(F.lit("pool")), F.array(F.when(F.size("_flags") > 0, "dropped").otherwise("kept")), F.transform("_flags", lambda f: F.concat(F.lit("rule "), f)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    kept = earlier(flagged.where(F.size("_flags") == 0).drop("_flags").withColumn("_all", F.lit(0)), ["_all"], order, name="rank").withColumn("rank", F.col("rank") + 1).drop("_all")
    first = counts.where("name = 'kept'").select(F.explode(F.array(*[F.struct(F.lit(f"first {n}").alias("name"), F.least("n", F.lit(n)).alias("n")) for n in sizes])).alias("x")).select("x.*")
    return kept, counts.unionByName(first)


def record_check(df: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """(key, error) of records(key, text, spans, keep) in a total order: what is wrong with each, and `duplicate id` for
    every record but the first of its id."""
    from opalspan.operators.ordered import before as earlier

    own = df.select(key, F.explode(record_errors(F.col("text"), F.col("spans"), F.col("keep"))).alias("error"))
    again = earlier(df.select(key, *[c for c in order if c != key]), [key], [c for c in order if c != key]).where("before > 0").select(key, F.lit("duplicate id").alias("error"))
    return own.unionByName(again)


def rule_quality(flags: DataFrame, audit: DataFrame, targets: tuple[str, ...] = ("CREDITCARDNUMBER", "AGE", "GENDER", "SEX", "TAXNUM")) -> DataFrame:
    """flags(doc_id, rule, start, end) against audit(doc_id, start, end, label, verdict): hits, false alarms,
    precision per rule, and recall over wrong spans of the target labels."""
    on = ["doc_id", "start", "end"]
    judged = flags.join(audit.drop("label"), on)
    wrong = F.col("verdict") != "ok"
    per = judged.groupBy("rule").agg(F.sum(wrong.cast("long")).alias("tp"), F.sum((~wrong).cast("long")).alias("fp"))
    lost = audit.where(wrong & F.col("label").isin(*targets)).join(flags.select(*on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    whole = per.crossJoin(F.broadcast(lost))
    return whole.select("rule", "tp", "fp", "fn", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 6).alias("recall"))


def record_errors(text: Column, spans: Column, keep: Column) -> Column:
    """Messages about a labelled record: unknown labels, wrong offsets, words cut through, overlaps, kept strings that
    are absent or overlap a span."""
    alnum = lambda c: c.rlike(r"(?U)^[\p{L}\p{N}]$")
    inside = lambda s: alnum(cut(text, s["start"] - 1, s["start"])) & (s["start"] > 0) | alnum(cut(text, s["end"], s["end"] + 1))
    quoted = lambda s: F.concat(F.lit("'"), s["text"], F.lit("'"))

    def of(s: Column, i: Column) -> Column:
        return F.array(
            F.when(~s["label"].isin(*LABELS), F.concat(F.lit("unknown label "), s["label"])),
            F.when(s["start"].isNull(), F.concat(F.lit("no offsets "), quoted(s))),
            F.when((F.length(s["text"]) > 0) & (s["text"] != cut(text, s["start"], s["end"])), F.concat(F.lit("offsets differ "), quoted(s))),
            F.when(inside(s), F.concat(F.lit("inside a word "), quoted(s))),
            F.when((i > 0) & (s["start"] < F.get(spans, i - 1)["end"]), F.concat(F.lit("overlaps previous "), quoted(s))),
        )

    at = lambda k: F.position(k, text)
    kept = lambda k: F.when(at(k) == 0, F.concat(F.lit("kept string absent "), k)).when(F.exists(spans, lambda s: (s["start"] < at(k) - 1 + F.length(k)) & (at(k) - 1 < s["end"])), F.concat(F.lit("kept string overlaps a span "), k))
    return F.filter(F.concat(F.flatten(F.transform(spans, of)), F.transform(F.coalesce(keep, F.array().cast("array<string>")), kept)), lambda e: e.isNotNull())


def occurrences(text: Column, value: Column, any_case: bool = False) -> Column:
    """Starts of whole-word occurrences of a literal value."""
    flag = "(?iU)" if any_case else "(?U)"
    pattern = F.concat(F.lit(flag + r"(?<!\w)\Q"), value, F.lit(r"\E(?!\w)"))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["pos"] + F.length(p) + F.length(value)).alias("pos"), F.concat(a["out"], F.array(a["pos"] + F.length(p))).alias("out"))
    return let(F.split(text, pattern, -1), lambda pieces: F.aggregate(F.slice(pieces, 1, F.greatest(F.lit(0), F.size(pieces) - 1)), begin, step, lambda a: a["out"]))


def filled(text: Column, given: Column) -> Column:
    """Values (label, text) without places, in order -> (place, label, text, start, end): each is the first whole-word
    occurrence at or after the end of the one before it, else the first of all; start is null if there is none."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:int,label:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        def chosen(places: Column) -> Column:
            start = F.coalesce(F.get(F.filter(places, lambda p: p >= acc["at"]), F.lit(0)), F.get(places, F.lit(0)))
            return let(start, lambda s: F.struct(F.coalesce(s + F.length(v["text"]), acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("place"), v["label"].alias("label"), v["text"].alias("text"), s.cast("int").alias("start"), (s + F.length(v["text"])).cast("int").alias("end")))).alias("out")))

        return let(occurrences(text, v["text"]), chosen)

    return F.aggregate(given, begin, step, lambda a: a["out"])


LABELLED = "array<struct<start:int,end:int,label:string,text:string>>"


def labelled(text: Column, values: Column) -> Column:
    """Spans of every occurrence of every supplied value(label, text), longest first, in any case, without overlaps."""
    longest = F.array_sort(values, lambda a, b: F.when(F.length(a["text"]) > F.length(b["text"]), -1).when(F.length(a["text"]) < F.length(b["text"]), 1).otherwise(0))

    def step(acc: Column, v: Column) -> Column:
        n = F.length(v["text"])
        free = F.filter(occurrences(text, v["text"], True), lambda i: ~F.exists(acc, lambda s: (i < s["end"]) & (s["start"] < i + n)))
        return F.concat(acc, F.transform(free, lambda i: F.struct(i.cast("int").alias("start"), (i + n).cast("int").alias("end"), v["label"].alias("label"), cut(text, i, i + n).alias("text"))))

    return F.array_sort(F.aggregate(longest, F.array().cast(LABELLED), step), lambda a, b: a["start"] - b["start"])


def rejection(text: Column, values: Column, keep: Column) -> Column:
    """Why a generated message is rejected; null if it is accepted. Reasons in order: length, an ambiguous or missing
    value, a company's telephone, a header's date, a look-alike given as a card, digits, an e-mail address or a titled
    name that nothing labels."""
    first = lambda a: F.try_element_at(F.filter(a, lambda x: x.isNotNull()), F.lit(1))
    plain = lambda v: F.lower(v["text"]).isin(*WORDLIKE) | v["text"].rlike(r"^\d{1,3}$")
    value = lambda v: F.when(plain(v) & (F.size(occurrences(text, v["text"], True)) != 1), F.concat(F.lit("ambiguous "), v["label"])).when(F.size(occurrences(text, v["text"])) == 0, F.concat(F.lit("missing value "), v["label"]))
    spans = labelled(text, values)

    def rest(spans: Column) -> Column:
        ok_keep = F.filter(keep, lambda k: (F.position(k, text) > 0) & ~F.exists(spans, lambda s: (s["start"] < F.position(k, text) - 1 + F.length(k)) & (F.position(k, text) - 1 < s["end"])))
        held = F.concat(positions(spans), F.flatten(F.transform(ok_keep, lambda k: F.flatten(F.transform(occurrences(text, k), lambda i: F.sequence(i, i + F.length(k) - 1))))))
        left = lambda s, n: cut(text, F.greatest(F.lit(0), s["start"] - n), s["start"])
        odd = lambda s: F.when((s["label"] == "TELEPHONENUM") & left(s, 40).rlike(COMPANY_PHONE), "phone given as the company's").when((s["label"] == "DATE") & left(s, 40).rlike(HEADER_DATE), "date used as a header date")
        lead = lambda k: cut(text, F.greatest(F.lit(0), F.position(k, text) - 31), F.position(k, text) - 1)
        card = F.exists(ok_keep, lambda k: (F.length(F.regexp_replace(k, r"\D", "")) >= 12) & ~F.lower(lead(k)).contains("gift") & lead(k).rlike(r"(?i)\bcard\b"))

        def loose(pattern: str, least: int = 0) -> Column:
            bare = lambda m: F.exists(F.filter(F.sequence(m["start"], m["end"] - 1), lambda i: ~F.array_contains(held, i)), lambda i: cut(text, i, i + 1).rlike(r"\S"))
            return F.exists(matches(text, pattern, "X"), lambda m: (F.length(F.regexp_replace(m["text"], r"\D", "")) >= least) & bare(m))

        return F.coalesce(first(F.transform(spans, odd)), F.when(card, "look-alike presented as a card"), F.when(loose(DIGIT_RUN, 7), "unlabelled digit run"), F.when(loose(EMAILISH), "unlabelled email"), F.when(loose(TITLE_NAME), "unlabelled title + name"))

    return F.when((F.length(text) == 0) | (F.length(text) > MAX_CHARS), "length").otherwise(F.coalesce(first(F.transform(values, value)), let(spans, rest)))


ANSWER = "struct<messages:array<struct<id:string,text:string,keep:array<string>>>>"


def collected(responses: DataFrame, specs: DataFrame) -> DataFrame:
    """responses(request, content) and specs(request, id, values, keep) -> (request, id, text, spans, reason), a row for
    each spec: the reason why nothing was made of it, or null and the labelled message.

    A content that is no JSON with messages makes all its specs unparseable; a spec without a message, or whose message
    has no text, is missing; others are judged by `rejection`. Of two messages with one id the last counts."""
    read = responses.select("request", F.from_json("content", ANSWER)["messages"].alias("m"))
    given = read.select("request", F.posexplode("m").alias("at", "m")).groupBy("request", F.col("m.id").alias("id")).agg(F.max_by("m", "at").alias("m"))
    both = specs.join(read.select("request", F.col("m").isNotNull().alias("_readable")), "request", "left").join(given, ["request", "id"], "left")
    text, keep = F.trim("m.text"), F.concat(F.coalesce("keep", F.array().cast("array<string>")), F.coalesce("m.keep", F.array().cast("array<string>")))
    judged = F.when(~F.coalesce("_readable", F.lit(False)), "unparseable response").when(text.isNull(), "missing message").otherwise(rejection(text, F.col("values"), keep))
    out = both.select("request", "id", text.alias("text"), "values", judged.alias("reason"))
    good = F.col("reason").isNull()
    return out.select("request", "id", F.when(good, F.col("text")).alias("text"), F.when(good, labelled(F.col("text"), F.col("values"))).alias("spans"), "reason")


NAME_LABELS = ("GIVENNAME", "SURNAME", "TITLE")


def contaminated(docs: DataFrame, evaluation: DataFrame, n: int = 8, key: str = "doc_id") -> DataFrame:
    """Keys of docs(key, text) that share an n-gram with evaluation(text). Evaluation grams are few and distinct; both
    sides are pre-aggregated to hashes before they meet."""
    grams = lambda df: F.explode(F.transform(word_ngrams(word_tokens(F.col("text")), n), lambda g: F.xxhash64(g)))
    known = evaluation.select(grams(evaluation).alias("gram")).distinct()
    return docs.select(key, grams(docs).alias("gram")).join(known, "gram", "left_semi").select(key).distinct()


def contaminated_values(docs: DataFrame, evaluation: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of docs whose span values, names apart, are values of evaluation's spans."""
    value = lambda df, *cols: df.select(*cols, F.explode("spans").alias("s")).where(~F.col("s.label").isin(*NAME_LABELS)).select(*cols, F.lower("s.text").alias("value"))
    return value(docs, key).join(value(evaluation).distinct(), "value", "left_semi").select(key).distinct()


def unnameable(labels: Column, allowed: tuple[str, ...] = MODEL_LABELS) -> Column:
    """Labels of a document that have no name here."""
    return F.array_except(labels, F.array(*map(F.lit, allowed)))

