"""The streaming vault: scopes die whole at their age, tenants share nothing, tokens come back as values."""

from __future__ import annotations

import hashlib
import hmac
import time
from datetime import UTC, datetime, timedelta

import pytest

from opalspan.functions.policy import policy
from opalspan.streaming.vault import vault_stream

KEY = bytes(range(32))
START = datetime(2024, 3, 9, 12, 0, tzinfo=UTC)
SCHEMA = "tenant string, conversation string, at timestamp, turn long, kind string, text string, spans array<struct<start:int,end:int,label:string,text:string,source:string,score:double>>"


def message(tenant, conversation, seconds, turn, kind, text, *values):
    spans = [(text.index(v), text.index(v) + len(v), "GIVENNAME", v, "gold", None) for v in values]
    return (tenant, conversation, START + timedelta(seconds=seconds), turn, kind, text, spans)


def streamed(spark, tmp_path, batches, ttl=100, key=KEY, name="vault"):
    """One file a batch, in order; (tenant, conversation, turn) -> (text, n)."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = vault_stream(stream, policy("analytics"), key, ttl=ttl, late="1 hour").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r["tenant"], r["conversation"], r["turn"]): (r["text"], r["n"]) for r in spark.table(name).collect()}


def test_scopes_age_whole(spark, tmp_path):
    batches = [
        [message("t", "c", 0, 1, "redact", "Priya met Ann", "Priya", "Ann"), message("t", "c", 90, 3, "redact", "Ann and Bo", "Ann", "Bo")],
        [message("t", "c", 50, 2, "restore", "to <GIVENNAME_1>, <GIVENNAME_2>, <GIVENNAME_9>"), message("t", "c", 100, 4, "restore", "<GIVENNAME_3>")],
        # a second older than the scope may be: the token of 90 goes with the scope of 0, and numbers begin again
        [message("t", "c", 101, 5, "restore", "<GIVENNAME_3> <GIVENNAME_1>"), message("t", "c", 102, 6, "redact", "Bo here", "Bo"), message("t", "c", 103, 7, "restore", "<GIVENNAME_1> <GIVENNAME_2>")],
    ]
    got = streamed(spark, tmp_path, batches, name="ages")
    assert got["t", "c", 1] == ("<GIVENNAME_2> met <GIVENNAME_1>", 2)
    assert got["t", "c", 2] == ("to Ann, Priya, <GIVENNAME_9>", 2)
    assert got["t", "c", 3] == ("<GIVENNAME_1> and <GIVENNAME_3>", 2)
    assert got["t", "c", 4] == ("Bo", 1)
    assert got["t", "c", 5] == ("<GIVENNAME_3> <GIVENNAME_1>", 0)
    assert got["t", "c", 6] == ("<GIVENNAME_1> here", 1)
    assert got["t", "c", 7] == ("Bo <GIVENNAME_2>", 1)


def test_tenants_share_nothing(spark, tmp_path):
    batches = [
        [message("a", "c", 0, 1, "redact", "Priya", "Priya"), message("b", "c", 1, 1, "redact", "Ann and Priya", "Ann", "Priya"), message(None, "c", 2, 1, "redact", "Zoe", "Zoe")],
        [message("a", "c", 3, 2, "restore", "<GIVENNAME_1> <GIVENNAME_2>"), message("b", "c", 3, 2, "restore", "<GIVENNAME_1> <GIVENNAME_2>"), message("a", "d", 3, 1, "restore", "<GIVENNAME_1>"), ("a", "c", None, 9, "redact", "lost", []), ("a", "c", START + timedelta(seconds=4), 3, "redact", None, None)],
    ]
    got = streamed(spark, tmp_path, batches, name="tenants")
    assert got["a", "c", 1] == ("<GIVENNAME_1>", 1) and got["b", "c", 1] == ("<GIVENNAME_2> and <GIVENNAME_1>", 2)
    assert got["a", "c", 2] == ("Priya <GIVENNAME_2>", 1) and got["b", "c", 2] == ("Priya Ann", 2)
    assert got["a", "d", 1] == ("<GIVENNAME_1>", 0) and got["", "c", 1] == ("<GIVENNAME_1>", 1)
    assert got["a", "c", 3] == ("", 0) and ("a", "c", 9) not in got


def test_state_holds_no_value(spark, tmp_path):
    streamed(spark, tmp_path, [[message("t", "c", 0, 1, "redact", "call Persephonella", "Persephonella")]], ttl=0, name="sealed")
    files = [p.read_bytes() for p in (tmp_path / "cp" / "state").rglob("*") if p.is_file()]
    assert files and not any(b"\x0dPersephonella" in f for f in files)
    with pytest.raises(ValueError):
        vault_stream(spark.createDataFrame([], SCHEMA), policy("analytics"), b"short")


def test_token_stream_ages_by_scope(spark, tmp_path):
    """By the clock: a scope that has died gives its numbers anew, and a tenant's values have tokens of their own."""
    from opalspan.streaming.redact import token_stream

    schema = "tenant string, conversation string, turn long, start int, label string, value string"
    source = str(tmp_path / "in")
    for rows in ([("t", "c", 1, 0, "CITY", "Leeds"), ("u", "c", 1, 0, "CITY", "York")], [("t", "c", 2, 0, "CITY", "York"), ("t", "c", 2, 9, "CITY", "Hull")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = token_stream(stream, KEY, 1).writeStream.format("memory").queryName("aged").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    end = time.monotonic() + 90  # by the clock a stream always has another batch: it ends when all rows are there
    while q.isActive and spark.table("aged").count() < 4 and time.monotonic() < end:
        time.sleep(0.5)
    q.stop()
    got = {(r["tenant"], r["turn"], r["start"]): r["token"] for r in spark.table("aged").collect()}
    assert got == {("t", 1, 0): "<CITY_1>", ("u", 1, 0): "<CITY_1>", ("t", 2, 9): "<CITY_1>", ("t", 2, 0): "<CITY_2>"}
    assert hmac.new(hashlib.sha256(b"pii-vault-lookup" + KEY).digest(), b"x", "sha256").digest()
