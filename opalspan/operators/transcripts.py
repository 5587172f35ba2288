"""Labels of conversations from the card of their scenario: names, addresses, telephones in any layout, introductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalspan.functions.spans import IGNORE, SPANS, by_start, cut, let, matches, overlaps, span
from opalspan.operators.rules import labelled

#: How an agent gives a name, how a user name is given, and words that are none. The character at a match or
#: before it is tried first: it rules out most places, which the long look-behinds would try at every length.
INTRODUCTION = r"(?=[A-Z])(?<=(?:this is|my name is|name's|I'm|I am)\s{1,9})[A-Z][a-z]+\b(?=\s*(?:from|here|,|\.|!|and|with|at|$))"
USER_NAME = r"(?i)(?<=[\s:=s])(?<=user\s?name\s{0,9}(?:is|:|=)\s{0,9})[A-Za-z0-9_.]*[A-Za-z0-9]"
NO_USER_NAMES = "first not the correct wrong incorrect still now also just customer agent and or please email is it was".split()
#: Card entries by the type that a conversation's placeholders have, and the label of their values.
TYPES = {"name": "GIVENNAME", "email": "EMAIL", "phone": "TELEPHONENUM", "street_address": "STREET", "city": "CITY", "zip_code": "ZIPCODE"}

_VALUE = "struct<label:string,text:string>"


def card_values(card: Column) -> Column:
    """A card (name, email, phone, street_address, city, zip_code, ignored: array) -> (label, text) of what to look for:
    names and streets whole, marked as such, and in parts."""
    of = lambda label, text: F.when(F.length(F.trim(text)) > 0, F.struct(F.lit(label).alias("label"), F.trim(text).alias("text")).cast(_VALUE))
    words = F.filter(F.split(F.coalesce(card["name"], F.lit("")), r"\s+"), lambda w: w != "")
    several = F.size(words) > 1
    street = F.regexp_extract(F.coalesce(card["street_address"], F.lit("")), r"^\s*[0-9]+\s+(.+)", 1)
    plain = [of(label, card[kind]) for kind, label in TYPES.items() if kind not in ("name", "street_address")]
    named = [F.when(several, of("NAME_FULL", card["name"])), of("GIVENNAME", F.get(words, F.lit(0))), F.when(several, of("SURNAME", F.try_element_at(words, F.lit(-1))))]
    placed = [of("STREET_FULL", card["street_address"]), of("STREET", street)]
    ignored = F.transform(F.coalesce(card["ignored"], F.array().cast("array<string>")), lambda v: of(IGNORE, v))
    return F.filter(F.concat(F.array(*named, *plain, *placed), ignored), lambda v: v.isNotNull())


def _parts(text: Column, s: Column) -> Column:
    """A whole name as given name and surname, a whole street as number and street, anything else as it is."""
    own = lambda a, b, label: span(a, b, F.lit(label), cut(text, a, b))
    first = F.length(F.regexp_extract(s["text"], r"^\S+", 0))
    last = F.length(F.regexp_extract(s["text"], r"\S+$", 0))
    number, lead = F.length(F.regexp_extract(s["text"], r"^([0-9]+)\s+", 1)), F.length(F.regexp_extract(s["text"], r"^[0-9]+\s+", 0))
    name = F.array(own(s["start"], s["start"] + first, "GIVENNAME"), own(s["end"] - last, s["end"], "SURNAME"))
    street = F.when(lead > 0, F.array(own(s["start"], s["start"] + number, "BUILDINGNUM"), own(s["start"] + lead, s["end"], "STREET"))).otherwise(F.array(own(s["start"], s["end"], "STREET")))
    rest = F.array(span(s["start"], s["end"], s["label"], s["text"]))
    return F.when(s["label"] == "NAME_FULL", name).when(s["label"] == "STREET_FULL", street).otherwise(rest).cast(SPANS)


def _digits_anyhow(text: Column, phone: Column) -> Column:
    """Places of a telephone's digits with any signs between them; a number of fewer than seven digits has none."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", "")
    pattern = F.concat(F.lit(r"(?<![\w(])\(?"), F.array_join(F.filter(F.split(digits, ""), lambda c: c != ""), r"[\s().-]*"), F.lit(r"(?!\w)"))
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda a, m: F.struct(a.alias("a"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["a"])
        end = start + F.length(p["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span(start, end, F.lit("TELEPHONENUM"), p["m"]))).alias("out"))

    found = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), begin, step, lambda acc: acc["out"])
    return F.when(F.length(digits) >= 7, found).otherwise(F.array().cast(SPANS))


def turn_spans(text: Column, card: Column, agent: Column) -> Column:
    """Spans of one turn: the card's values, longest first; telephones in any layout; the number before a street that
    has none; the name by which an agent is introduced; a user name that is given, as IGNORE. Of two that overlap the
    earlier in this order stays. The turn is bound once: lambdas would make its text and card again for each element."""
    turn = F.struct(F.coalesce(text, F.lit("")).alias("text"), card.alias("card"), agent.alias("agent"))
    return let(turn, lambda t: _turn_spans(t["text"], t["card"], t["agent"]))


def _turn_spans(text: Column, card: Column, agent: Column) -> Column:
    free = lambda taken, more: F.concat(taken, F.filter(more, lambda m: ~F.exists(taken, lambda s: overlaps(s, m))))
    own = F.flatten(F.transform(labelled(text, card_values(card)), lambda s: _parts(text, s)))

    def numbers(spans: Column) -> Column:
        streets = F.filter(spans, lambda s: s["label"] == "STREET")
        before = lambda s: F.regexp_extract(cut(text, F.lit(0), s["start"]), r"(?<!\w)([0-9]{1,6}\s+)$", 1)
        made = F.transform(streets, lambda s: let(before(s), lambda b: span(s["start"] - F.length(b), s["start"] - F.length(b) + F.length(F.rtrim(b)), F.lit("BUILDINGNUM"), F.rtrim(b))))
        return F.filter(made, lambda s: s["end"] > s["start"])

    with_phones = let(own, lambda s: free(s, _digits_anyhow(text, card["phone"])))
    with_numbers = let(with_phones, lambda s: free(s, numbers(s)))
    names = F.when(agent, matches(text, INTRODUCTION, "GIVENNAME", "gold")).otherwise(F.array().cast(SPANS))
    users = F.filter(matches(text, USER_NAME, IGNORE, "gold"), lambda s: ~F.lower(s["text"]).isin(*NO_USER_NAMES))
    return by_start(let(let(with_numbers, lambda s: free(s, names)), lambda s: free(s, users)).cast(SPANS))


def placeholders(delexed: Column) -> Column:
    """Types of the placeholders <type> of a turn whose values have been taken out."""
    return F.regexp_extract_all(delexed, F.lit(r"<([a-z_]+)>"), F.lit(1))
