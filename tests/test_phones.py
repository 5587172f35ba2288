"""Numbers by plan: cases of four regions, and the trie against a walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from opalspan.functions import phones

CASES = [
    # written, number and region, or none
    ("+1 212-736-5000", "12127365000", "US"),
    ("(415) 555-0147", "14155550147", "US"),
    ("1 415 555 0147", "14155550147", "US"),
    ("+1 416 736 5000", "14167365000", "CA"),
    ("604-555-0199", "16045550199", "CA"),
    ("+1 876 555 0199", "18765550199", "001"),
    ("800 555 0199", "18005550199", "001"),
    ("415 155 0147", "914151550147", "IN"),  # no exchange begins with 1; at home in India it is a fixed line
    ("+1 415 911 0147", None, None),
    ("+1 391 555 0147", None, None),
    ("+1 375 555 0147", None, None),
    ("+1 415 555 014", None, None),
    ("020 7946 0018", "442079460018", "GB"),
    ("+44 20 7946 0018", "442079460018", "GB"),
    ("07700 900 518", "447700900518", "GB"),
    ("0800 111 111", "44800111111", "GB"),
    ("+44 2207 946001", None, None),
    ("+44 770 090 051", None, None),
    ("+91 98765 43210", "919876543210", "IN"),
    ("99765 43210", "919976543210", "IN"),
    ("98765 43210", "19876543210", "US"),  # any area code by the plan's rules, assigned or not, and the first region wins
    ("0 98765 43210", "919876543210", "IN"),
    ("+91 0987 654321", None, None),
    ("+91 98765 4321", None, None),
    ("011 44 20 7946 0018", "442079460018", "GB"),
    ("00 1 212 736 5000", "12127365000", "US"),
    ("+49 30 901820", "4930901820", "001"),
    ("+999 123 456 789", None, None),
    ("123 45", None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(CASES)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", phones.read(F.col("v")).alias("r")).collect()}
    for i, (value, number, region) in enumerate(CASES):
        if region is None:
            assert got[i] is None, (value, got[i])
        else:
            assert got[i] is not None and (got[i]["number"], got[i]["region"]) == (number, region), (value, got[i])
    assert {r for _, _, r in CASES if r} == {"US", "CA", "GB", "IN", "001"}


def walked(number):
    """Digit by digit down a trie; the last prefix on the way that has an entry decides."""
    trie: dict = {}
    for prefix, *row in phones.plan():
        node = trie
        for c in prefix:
            node = node.setdefault(c, {})
        node[""] = (len(prefix), *row)
    node, last = trie, None
    for c in number:
        node = node.get(c)
        if node is None:
            break
        last = node.get("", last)
    if last is None:
        return None
    size, low, high, kind, region = last
    code = next(n for n in (3, 2, 1) if number[:n] in {"1", "44", "91", *phones.ABROAD})
    if len(number) <= size or not low <= len(number) - code <= high:
        return None
    if number[0] == "1" and (number[4:5] in "01" or number[5:7] == "11"):
        return None
    return region, kind


def test_against_a_walk(spark):
    r = random.Random(8)
    starts = ["1", "1", "44", "44", "91", "91", "9", "3", ""]
    rows = [(r.choice(starts) + "".join(r.choices("0123456789", k=r.randint(0, 13))),) for _ in range(3000)] + [("",)]
    got = spark.createDataFrame(rows, "n string").select("n", phones.known(F.col("n")).alias("k")).collect()
    assert {x["n"]: x["k"] and tuple(x["k"]) for x in got} == {n: walked(n) for (n,) in rows}
    assert sum(walked(n) is not None for (n,) in rows) > 150


def test_prefixes_are_single():
    prefixes = [p for p, *_ in phones.plan()]
    assert len(prefixes) == len(set(prefixes)) and not set(phones.CANADA) & set(phones.ISLANDS)
    assert all(len(a) == 3 and a[1] != "9" for a in phones.CANADA)


@pytest.mark.parametrize("text,found", [("call 07700 900 518, or +1 212-736-5000.", ["07700 900 518", "+1 212-736-5000"]), ("order 55120931 x", []), (None, []), ("", [])])
def test_spans(spark, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(phones.phones_by_plan(F.col("t")).alias("s")).first()
    assert [s["text"] for s in row["s"]] == found
    assert all(text[s["start"] : s["end"]] == s["text"] and s["label"] == "TELEPHONENUM" for s in row["s"])
