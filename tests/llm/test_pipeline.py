from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from opalspan.llm import mil_quality, pii_disclosure
from opalspan.llm.common import written

SF = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = (text or "").encode().lower().decode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def groups(texts):
    """doc_id -> smallest doc_id reachable over pairs with Jaccard 0.8 or more."""
    sets, low = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    while True:
        before = dict(low)
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def without_repeats(texts, length):
    """Rows of texts without every byte of a string of `length` bytes that starts in two places."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for b in raws:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = written(stage(spark, docs, SF), name)
        rows = out.collect()
        seen[name] = before, rows
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out
    before, rows = seen["quality"]
    model = mil_quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    good = {d for d, t in before.items() if model.score([mil_quality.passages(t)])[0] >= 0.3}
    assert {r["doc_id"] for r in rows} == good
    before, rows = seen["near_duplicates"]
    assert {r["doc_id"] for r in rows} == set(groups(before).values())
    before, rows = seen["repeated_passages"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}
    want = dict(zip(before, without_repeats(before.values(), corpus_pipeline.PASSAGE)))
    assert got == {d: (t, len(t)) for d, t in want.items()} and any(want[d] != (before[d] or "") for d in want)
    before, rows = seen["personal_data"]
    assert all(not pii_disclosure.base_spans(r["text"]) for r in rows)
    before, rows = seen["packing"]
    assert {r["doc_id"] for r in rows} == set(before)


def test_personal_data_workers(spark):
    """One Python function in the stage that reads texts: a second one takes a second Python worker of each task, and an
    executor keeps them all for the stages that follow."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = pii_disclosure.sanitise(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("MapInArrow") == 1


def test_planted_passages(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 55, 60, 70, 90)]
    rows = [(k, f"{text(60)} {passages[k % 5]} {text(60)}", "en", "s", 0) for k in range(20)] + [(100 + k, text(200), "en", "s", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert [got[k] for k, *_ in rows] == without_repeats([x[1] for x in rows], corpus_pipeline.PASSAGE)
    assert all(passages[k % 5] not in got[k] and len(got[k]) > 500 for k in range(20))
    assert all(got[d] == t for d, t, *_ in rows if d >= 100)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, terms string, spans string, tkey long, _first long, component_id long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, tmp_path, name, stage):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, clashing columns."""
    labels = [(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    r = random.Random(2)
    rest = (None, None, None, 0.5, "r", "t", "s", 1, 2, 3)
    rows = [(k, " ".join(f"w{r.randrange(500)}" for _ in range(60)) + ("#" * 300 if k % 2 == 0 else ""), *rest) for k in range(40)]
    rows += [(50, None, *rest), (51, "", *rest), (52, "", *rest), (53, " ".join(f"v{r.randrange(900)}" for _ in range(60_000)), *rest), (None, "no id a@b.co", *rest), (None, None, *rest), (54, rows[1][1], *rest), rows[5], rows[5]]
    df = spark.createDataFrame(rows, COLUMNS)
    out = stage(spark, df, str(tmp_path)).collect()
    ids = [x["doc_id"] for x in out]
    if name == "packing":
        sizes = {}
        for x in out:
            sizes.setdefault(x["doc_id"], []).append(x["length"])
        assert set(ids) == {x[0] for x in rows} and sum(sizes[51]) == 1 and sum(sizes[5]) == 3 * sum(x["length"] for x in out if x["doc_id"] == 5) / 3
    else:
        assert set(out[0].asDict()) == set(df.columns) and all(x["row"] == "r" and x["tkey"] == 1 for x in out)
        if name == "near_duplicates":
            assert sorted(d for d in ids if d is not None) == [*range(40), 50, 53] and ids.count(None) == 2
        elif name != "quality":
            assert sorted(map(str, ids)) == sorted(str(x[0]) for x in rows)
    assert stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path)).count() == 0
