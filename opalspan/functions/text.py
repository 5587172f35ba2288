"""Text columns: normalising, shingles, names, numbers in words."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from opalspan.functions.spans import SPANS, cut, let

#: Characters without width, and characters that look like ASCII ones and that NFKC leaves as they are.
ZERO_WIDTH = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad")
LOOK_ALIKES = {
    "о": "o", "О": "O", "а": "a", "е": "e", "р": "p", "с": "c", "х": "x", "у": "y",
    "Ο": "O", "ο": "o", "Ι": "I", "ι": "i",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
HONORIFICS = "mr mrs ms miss mx dr prof sir madam mister madame".split()
PARTICLES = "van von de der den da di du la le del della ten ter bin al el dos das uit".split()
PLACEHOLDER = r"(?iU)[\d_@]|^(?:partner|party|client|customer|buyer|seller|employee|user|tenant|landlord|borrower|lender|company|recipient|sender|applicant|member|director|manager)\b"
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
NUMBERS = DIGIT_WORDS + "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

NORMAL = "struct<text:string,origin:array<int>>"
#: Characters of normalised texts that leave a Python worker together.
PIECE = 1 << 18


@functools.cache
def _plain(c: str) -> str:
    """The normal form of one character; empty for those without width."""
    return "" if c in ZERO_WIDTH else LOOK_ALIKES[c] if c in LOOK_ALIKES else unicodedata.normalize("NFKC", c)


def _normal(text: str) -> tuple[str, np.ndarray]:
    forms = [_plain(c) for c in text]
    return "".join(forms), np.repeat(np.arange(len(forms), dtype=np.int32), np.fromiter(map(len, forms), np.int32, len(forms)))


def normalise_text(text: str) -> tuple[str, list[int]]:
    """The normal forms of the characters, end to end: sequences are not composed. With the place in text of each
    character of the result: a place stands as often as its form is long."""
    normal, origin = _normal(text)
    return normal, origin.tolist()


def _normalised(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A batch comes back in pieces of at most PIECE characters, or one text: places take several times a text's memory."""
    for batch in texts:
        pairs, size = [], 0
        for t in batch:
            t = t or ""
            if pairs and size + len(t) > PIECE:
                yield pd.DataFrame(pairs, columns=["text", "origin"])
                pairs, size = [], 0
            pairs.append(_normal(t))
            size += len(t)
        if pairs:
            yield pd.DataFrame(pairs, columns=["text", "origin"])


def normalised(text: Column) -> Column:
    """(text, origin). Plain ASCII text, which cannot change, needs no origin: it is null there, and offsets stay. Such a
    text is not sent to Python either, where every branch of a case runs."""
    ascii_ = text.rlike(r"^\p{ASCII}*$")
    plain = F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("origin"))
    return F.when(ascii_, plain).otherwise(F.pandas_udf(_normalised, NORMAL)(F.when(~ascii_, text)))


def to_original(origin: Column, start: Column, end: Column) -> Column:
    """[start, end) of the normalised text in the original; an empty span stays empty at its start."""
    a, b = F.get(origin, start), F.get(origin, end - 1) + 1
    moved = F.struct(F.coalesce(a, start).cast("int").alias("start"), F.when(start < end, F.coalesce(b, end)).otherwise(start).cast("int").alias("end"))
    moved = F.when(start < end, moved).otherwise(F.struct(start.cast("int").alias("start"), start.cast("int").alias("end")))
    return F.when(origin.isNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).otherwise(moved)


def spans_to_original(text: Column, origin: Column, spans: Column) -> Column:
    def back(s: Column) -> Column:
        at = to_original(origin, s["start"], s["end"])
        return s.withField("start", at["start"]).withField("end", at["end"]).withField("text", cut(text, at["start"], at["end"]))

    return F.transform(spans, back).cast(SPANS)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def _grams(tokens: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(tokens, i - 1 + k) for k in range(n)])))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Different n-word strings; n words or fewer are one string."""
    return let(tokens, lambda t: F.when(F.size(t) > n, _grams(t, n)).otherwise(F.array(F.array_join(t, " "))))


def word_ngrams(tokens: Column, n: int = 8) -> Column:
    """Different n-word strings; fewer than n words have none."""
    return let(tokens, lambda t: F.when(F.size(t) >= n, _grams(t, n)).otherwise(F.array().cast("array<string>")))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def size_name(n: Column) -> Column:
    whole = (n >= 1000) & (n % 1000 == 0)
    return F.when(whole, F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def number_words(n: Column) -> Column:
    """0 to 999 in words."""
    small, tens = F.array(*map(F.lit, NUMBERS)), F.array(*map(F.lit, ["", "", *TENS]))
    under = lambda x: F.when(x < 20, F.get(small, x)).otherwise(F.concat(F.get(tens, (x / 10).cast("int")), F.when(x % 10 > 0, F.concat(F.lit("-"), F.get(small, x % 10))).otherwise("")))
    hundreds = F.concat(F.get(small, (n / 100).cast("int")), F.lit(" hundred"), F.when(n % 100 > 0, F.concat(F.lit(" and "), under(n % 100))).otherwise(""))
    return F.when(n < 100, under(n)).otherwise(hundreds)


def spoken(digits: Column) -> Column:
    """Digits in words: zero is oh, two or three equal ones in a row are double or triple. The inverse is unspoken."""
    word = F.create_map(*[F.lit(x) for kv in ({str(i): w for i, w in enumerate(DIGIT_WORDS)} | {"0": "oh"}).items() for x in kv])
    runs = F.regexp_extract_all(digits, F.lit(r"([0-9])\1{0,2}"), F.lit(0))
    times = lambda r: F.element_at(F.array(F.lit(""), F.lit("double "), F.lit("triple ")), F.length(r))
    return F.array_join(F.transform(runs, lambda r: F.concat(times(r), F.try_element_at(word, F.left(r, F.lit(1))))), " ")


def unspoken(text: Column) -> Column:
    """Spoken digits as digits. Words stand between white space and , - . / and are taken in any case: a digit's name, oh
    is 0, hundred is 00, plus is left out, and of any other word its own digits stay. double and triple wait for the
    next digit's name."""
    names = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | {"oh": "0"}
    digit = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    tokens = F.filter(F.split(F.lower(text), r"(?U)[\s,./-]+"), lambda w: w != "")
    state = lambda times, out: F.struct(times.alias("times"), out.alias("out"))

    def step(acc: Column, w: Column) -> Column:
        named = F.try_element_at(digit, w)
        own = F.when(w == "hundred", F.lit("00")).otherwise(F.regexp_replace(w, r"(?U)[^\d]", ""))
        said = state(F.lit(1), F.concat(acc["out"], F.repeat(named, acc["times"])))
        return F.when(w.isin("double", "triple"), state(F.when(w == "double", 2).otherwise(3), acc["out"])).when(named.isNotNull(), said).otherwise(state(acc["times"], F.concat(acc["out"], own)))

    return F.aggregate(tokens, state(F.lit(1), F.lit("")), step, lambda acc: acc["out"])


def split_name(name: Column) -> Column:
    """A full name -> (title, given, surname); null for placeholders: digits, roles, a last token of one letter.

    Leading honorifics are the title; the last token, with particles before it, the surname; a single name is a surname
    after a title and a given name alone. The first name is never taken for a particle.
    """
    tokens = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    honorific = lambda w: F.lower(F.regexp_replace(w, r"\.+$", "")).isin(HONORIFICS)
    led = F.aggregate(tokens, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.when(a["on"] & honorific(w), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))), lambda a: a["n"])
    join = lambda a: F.nullif(F.array_join(a, " "), F.lit(""))
    rest = F.slice(tokens, led + 1, F.size(tokens))
    back = F.aggregate(F.reverse(F.slice(rest, 2, F.greatest(F.lit(0), F.size(rest) - 2))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.when(a["on"] & F.lower(w).isin(PARTICLES), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))), lambda a: a["n"])
    given = F.slice(rest, 1, F.greatest(F.lit(0), F.size(rest) - 1 - back))
    surname = F.slice(rest, F.size(rest) - back, back + 1)
    title = join(F.slice(tokens, 1, led))
    one, several = F.size(rest) == 1, F.size(rest) > 1
    part = lambda t, g, s: F.struct(t.alias("title"), g.alias("given"), s.alias("surname"))
    none = F.lit(None).cast("string")
    bad = (F.size(tokens) == 0) | name.rlike(PLACEHOLDER) | ((F.size(tokens) > 1) & (F.length(F.try_element_at(tokens, F.lit(-1))) == 1))
    return F.when(bad, F.lit(None)).when(one & title.isNotNull(), part(title, none, join(rest))).when(one, part(none, join(rest), none)).when(several, part(title, join(given), join(surname)))
