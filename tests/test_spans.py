from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from opalspan.functions import detect as d
from opalspan.functions import spans as sp
from opalspan.functions import text as tx
from opalspan.functions.policy import Policy, hmac_sha256, policy, redacted
from opalspan.operators import merge
from opalspan.plans.redaction import redact


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def values(spark, text, detector):
    return [s["text"] for s in one(spark, text, detector(F.col("text")))]


def rows(*spans):
    return [(a, b, lab, "", src, None) for a, b, lab, src in spans]


def algebra(spark, given, build):
    df = spark.createDataFrame([("x" * 60, given)], f"text string, s {sp.SPANS}")
    return [(s["start"], s["end"], s["label"], s["source"]) for s in df.select(build(F.col("text"), F.col("s")).alias("o")).first()["o"]]


def test_detectors(spark):
    assert values(spark, "card 4111 1111 1111 1111, gift card 6034 9321 0075 5510, amex 3782-822463-10005", d.cards) == ["4111 1111 1111 1111", "3782-822463-10005"]
    assert values(spark, "mixed separators 4111-1111 1111.1111", d.cards) == []
    assert values(spark, "is DE89370400440532013000 it", d.ibans) == ["DE89370400440532013000"]
    assert values(spark, "mail j.doe+x@example.co.uk, not a@b", d.emails) == ["j.doe+x@example.co.uk"]
    assert values(spark, "from 192.0.2.17 and 2001:db8::1, version 1.2.3, 999.1.1.1, 01.2.3.4", lambda t: F.concat(d.ipv4(t), d.ipv6(t))) == ["192.0.2.17", "2001:db8::1"]
    assert values(spark, "call (415) 555-2671 or 020 7946 0958; order 88213409", d.phones) == ["(415) 555-2671", "020 7946 0958"]
    assert values(spark, "", d.validators) == []


def test_offsets_are_code_points(spark):
    s = one(spark, "é🙂 a@b.co, c@d.org", d.emails(F.col("text")))
    assert [(x["start"], x["end"]) for x in s] == [(3, 9), (11, 18)]


def test_recall_first_union(spark):
    given = rows((5, 15, "PHONE", "llm"), (5, 18, "TELEPHONENUM", "validator"), (20, 30, "EMAIL", "validator"), (31, 34, "GIVENNAME", "llm"), (34, 37, "SURNAME", "llm"))
    assert algebra(spark, given, merge.recall_first_union) == [(5, 18, "TELEPHONENUM", "merged"), (20, 30, "EMAIL", "validator"), (31, 34, "GIVENNAME", "llm"), (34, 37, "SURNAME", "llm")]
    assert algebra(spark, [], merge.recall_first_union) == []


def test_merge_and_contained(spark):
    given = rows((0, 5, "A", "gold"), (3, 8, "A", "gold"), (3, 8, "B", "gold"))
    assert [x[:3] for x in algebra(spark, given, lambda t, s: merge.merge_same_label(s))] == [(0, 8, "A"), (3, 8, "B")]
    given = rows((0, 20, "EMAIL", "gold"), (8, 20, "OTHER", "gold"), (25, 30, "DATE", "gold"))
    assert [x[:2] for x in algebra(spark, given, lambda t, s: merge.drop_contained(s))] == [(0, 20), (25, 30)]


def test_policies(spark):
    out = redact(spark.createDataFrame([("mail jоhn@example.com now​ 4111１111 1111 1111",), (None,), ("x" * 50,)], "text string"), policy("support"), limit=45).collect()
    assert out[0]["redacted"] == "mail [EMAIL] now​ [CREDITCARDNUMBER]"
    assert out[1]["redacted"] == "" and out[2]["redacted"] is None and out[2]["error"] == "text_too_long"
    import hashlib
    import hmac

    assert one(spark, "message", hmac_sha256(b"key", F.col("text"))) == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    for bad in (lambda: Policy("burn"), lambda: policy("../x"), lambda: policy("none"), lambda: redacted(F.lit(""), sp.no_spans(), Policy("hash"))):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_text(spark):
    names = {"Dr. Ann van der Berg": ("Dr.", "Ann", "van der Berg"), "Nancy": (None, "Nancy", None), "Dr. Patel": ("Dr.", None, "Patel"), "Partner A": None}
    for name, parts in names.items():
        got = one(spark, name, tx.split_name(F.col("text")))
        assert (got and tuple(got)) == parts
    assert one(spark, "Hi Ann Lee, bye", tx.shingles(tx.words(F.col("text")), 5)) == ["hi ann lee, bye"]
    assert one(spark, "a b c", tx.word_ngrams(tx.word_tokens(F.col("text")), 8)) == []
    assert one(spark, "", tx.number_words(F.lit(342))) == "three hundred and forty-two"
    assert one(spark, "", tx.size_name(F.lit(50000))) == "50k"


def test_masks(spark):
    df = spark.createDataFrame([("Hi Ann Lee, bye", rows((3, 6, "GIVENNAME", "g"), (7, 10, "SURNAME", "g"), (4, 9, "X", "g")))], f"text string, s {sp.SPANS}")
    t, s = F.col("text"), F.col("s")
    assert df.select(sp.masked(t, s)).first()[0] == "Hi [GIVENNAME] [SURNAME], bye"
    assert df.select(sp.inline_masked(t, F.slice(s, 1, 1))).first()[0] == "Hi [GIVENNAME: Ann] Lee, bye"
    assert [tuple(x) for x in df.select(sp.highlights(t, F.slice(s, 1, 2))).first()[0]] == [("Hi ", None), ("Ann", "GIVENNAME"), (" ", None), ("Lee", "SURNAME"), (", bye", None)]


def test_normalised_in_pieces(spark):
    """A batch of long texts leaves the worker in pieces."""
    texts = ["é" * (tx.PIECE // 2), "ab", "e​", None, "ﬁ" * tx.PIECE, "x" * tx.PIECE]
    pieces = list(tx._normalised(iter([pd.Series(texts)])))
    assert [len(p) for p in pieces] == [4, 1, 1] and all(o.itemsize == 4 for p in pieces for o in p["origin"])
    want = [tx.normalise_text(t or "") for t in texts]
    assert [(t, o.tolist()) for p in pieces for t, o in zip(p["text"], p["origin"])] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = {r["id"]: (r["n"]["text"], r["n"]["origin"]) for r in df.select("id", tx.normalised(F.coalesce("text", F.lit(""))).alias("n")).collect()}
    assert got == {i: (t or "", None) if (t or "").isascii() else want[i] for i, t in enumerate(texts)}
