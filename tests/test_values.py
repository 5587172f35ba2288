"""Values in texts against patterns, one value at a time."""

from __future__ import annotations

import random
import re

import pytest

from opalspan.operators import values

VALUES = [(1, "Ann"), (2, "Ann Lee"), (3, "ann lee"), (4, "lee"), (5, "a"), (6, "ab a"), (7, "b-c"), (8, "Zoë"), (9, ""), (10, None), (11, "a a"), (12, "lee ann"), (13, "+1 (2)")]


def texts(seed):
    r = random.Random(seed)
    words = ["Ann", "Lee", "ann", "LEE", "a", "ab", "b-c", "zoë", "İ", "x", "annlee", "+1 (2)", "a_a"]
    rows = [(k, r.choice(["", " ", "("]) + "".join(r.choice(words) + r.choice([" ", " ", "", ", ", "\n", "ü"]) for _ in range(r.randint(0, 14)))) for k in range(150)]
    return rows + [(900, None), (901, ""), (902, "a"), (None, "Ann Lee"), *rows[:3]]


def by_pattern(text, each=VALUES):
    out = []
    for i, v in each:
        if v and text:
            out += [(m.start(), m.end(), i) for m in re.finditer(r"(?<!\w)" + re.escape(v) + r"(?!\w)", text, re.IGNORECASE)]
    return sorted(out)


@pytest.mark.parametrize("chars", [10_000, 7, 3])
def test_found(spark, chars):
    rows = texts(chars)
    found = values.found_values(spark.createDataFrame(rows, "doc long, text string"), "doc", spark.createDataFrame(VALUES, "value_id long, value string"), chars)
    assert found.columns == ["doc", "value_id", "start", "end"]
    got = sorted(((r["doc"], r["start"], r["end"], r["value_id"]) for r in found.collect()), key=repr)
    want = sorted(((d, *x) for d, t in rows for x in by_pattern(t)), key=repr)
    assert got == want and len(want) > 100


def test_placed(spark):
    rows = [(d, t) for d, t in texts(4) if d is not None][:150]
    found = values.found_values(spark.createDataFrame(rows, "doc long, text string"), "doc", spark.createDataFrame(VALUES, "value_id long, value string"))
    got = sorted((r["doc"], r["start"], r["end"], r["value_id"]) for r in values.placed(found, "doc").collect())
    want = []
    for d, t in rows:
        taken = []
        for i, v in sorted((x for x in VALUES if x[1]), key=lambda x: (-len(x[1]), x[0])):
            for s, e, _ in by_pattern(t, [(i, v)]):
                if not any(s < y and x < e for x, y, _ in taken):
                    taken.append((s, e, i))
        want += [(d, *x) for x in taken]
    assert got == sorted(want)


def test_nothing(spark):
    none = spark.createDataFrame([], "value_id long, value string")
    docs = spark.createDataFrame(texts(1), "doc long, text string")
    assert values.found_values(docs, "doc", none).collect() == []
    assert values.found_values(docs.limit(0), "doc", spark.createDataFrame(VALUES, "value_id long, value string")).collect() == []
