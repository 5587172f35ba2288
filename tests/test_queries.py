"""Queries against their SQL, and streams."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from opalspan.plans.gateway import GATEWAY
from opalspan.plans.oracle import ORACLE
from opalspan.plans.queries import QUERIES
from opalspan.plans.relations import RELATIONS
from opalspan.plans.source_queries import SOURCES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, bool | int | str) else str(v)


@pytest.mark.parametrize("name", ["detect_validators", "span_union_recall_first", "span_union_relation", "redact_mask_support", "score_docs", "metrics_by_group", "bootstrap_ci", "known_misses", "stratified_order", "ngram_contamination_benchmark", "sweep_candidates", "rate_limit_sliding", "decision_matrix", "near_dup_exact_classes", "fill_offsets", "transcript_cards", "collect_responses", "chunk_text", "token_numbering", "restore_roundtrip", "vault_ttl_purge", "iban_seeded", "ipv6_seeded", "normalize_look_alikes", "spoken_digits", "split_name", "parse_llm_json", "missed_by_label", "pseudonymize_conversations", "highlights", *SOURCES, *GATEWAY, *RELATIONS])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    more = SOURCES | GATEWAY | RELATIONS
    query, sql = more[name] if name in more else (QUERIES[name], ORACLE[name])
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(sql)
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_token_stream(spark, tmp_path):
    from opalspan.streaming.redact import token_stream

    rows = [("c", 1, 5, "GIVENNAME", "Priya"), ("c", 1, 20, "GIVENNAME", "Ann"), ("c", 2, 0, "GIVENNAME", "Priya"), ("d", 1, 0, "GIVENNAME", "Ann")]
    schema = "conversation string, turn long, start int, label string, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = token_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), bytes(range(32)), 0).writeStream.format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["conversation"], r["turn"], r["start"]): r["token"] for r in spark.table("tokens").collect()}
    assert got == {("c", 1, 20): "<GIVENNAME_1>", ("c", 1, 5): "<GIVENNAME_2>", ("c", 2, 0): "<GIVENNAME_2>", ("d", 1, 0): "<GIVENNAME_1>"}


def test_redact_stream(spark):
    assert QUERIES["stream_redact"](spark, SF).where(F.col("redacted").contains("[EMAIL]")).count() > 0


def test_near_lsh_all_pairs(spark, tmp_path):
    import random

    r = random.Random(7)
    rows = []
    for k in range(12):
        w = r.choices([f"w{i}" for i in range(500)], k=80)
        rows.append((k, " ".join(w), "en"))
        w[-1] = "x"
        rows += [(100 + k, " ".join(w), r.choice(["en", None])), (200 + k, " ".join(w), "de"), (300 + k, " ".join(w[:40]), "en")]
    w = [f"e{i}" for i in range(40)]
    rows += [(400, None, None), (401, "", "en"), (402, " ".join(w), "en"), (403, " ".join([*w[:36], "f", "g", "h", "i"]), "en"), (404, " ".join(w[:30]), "en"), (405, " ".join([*w[:30], "h", "i"]), "en")]
    rows += [(406, " ".join(w[:24]), "en"), (407, " ".join(w[:20]), "en")]  # 16 of 20 shingles: 0.8 exactly
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x["id"], x["other"], round(x["jaccard"], 6)) for x in QUERIES["near_dup_lsh"](spark, str(tmp_path)).collect())
    texts = {d: t or "" for d, t, _ in rows}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    want = [(d, first[t], 1.0) for d, t in texts.items() if first[t] != d]
    sets = {d: grams(t.split()) for t, d in first.items()}
    want += [(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any(x[2] == 0.8 for x in want) and any(x[2] > 0.8 for x in want) and got == sorted(want)
