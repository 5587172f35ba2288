"""The vault as a stream: scopes kept by (tenant, conversation), whole until their age, ciphertext in the state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from opalspan.functions.policy import Policy, entities, hmac_sha256, replacement
from opalspan.functions.spans import SPANS, cut, replaced
from opalspan.operators.vault import TOKEN, TTL_SECONDS

_WANTED = "array<struct<label:string,digest:string,sealed:binary>>"
_KNOWN = "array<struct<token:string,digest:string,sealed:binary>>"
_OUT = f"tenant string, conversation string, at timestamp, turn long, _row string, _tokens array<string>, _known {_KNOWN}"


class Scope(StatefulProcessor):
    """State of one (tenant, conversation): when its first token was made, each value's token by the value's keyed digest,
    the digest and ciphertext by token, the last number of each label.

    A row asks for tokens of values (spans, in the order in which they are numbered) or for what tokens stand for. Rows
    of a batch come in no order and are taken by time, then turn. A scope older than the time to live is empty for the row
    that finds it so: all of it goes together, and its numbers begin again. A timer frees the state of scopes that no row
    comes to any more. Values are sealed before they come here and opened after they leave.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("v", StringType())])
        self.handle = handle
        self.created = handle.getValueState("created", StructType([StructField("ms", LongType())]))
        self.tokens = handle.getMapState("tokens", text, text)
        self.sealed = handle.getMapState("sealed", text, StructType([StructField("digest", StringType()), StructField("sealed", BinaryType())]))
        self.counters = handle.getMapState("counters", text, StructType([StructField("n", IntegerType())]))

    def _born(self, now: int) -> int | None:
        """When the scope was made, if it still lives."""
        born = self.created.get()[0] if self.created.exists() else None
        if born is not None and self.ttl and now - born > self.ttl:
            self._clear()
            return None
        return born

    def _clear(self) -> None:
        for state in (self.created, self.tokens, self.sealed, self.counters):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _token(self, label: str, digest: str, sealed) -> str:
        if self.tokens.containsKey((digest,)):
            return self.tokens.getValue((digest,))[0]
        n = self.counters.getValue((label,))[0] + 1 if self.counters.containsKey((label,)) else 1
        token = f"<{label}_{n}>"
        self.counters.updateValue((label,), (n,))
        self.tokens.updateValue((digest,), (token,))
        self.sealed.updateValue((token,), (digest, bytes(sealed)))
        return token

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r["_ms"], r["turn"], r["_row"])):
            born, got, known = self._born(r["_ms"]), [], []
            if r["_wanted"]:
                if born is None:
                    self.created.update((r["_ms"],))
                    if self.ttl:
                        self.handle.registerTimer(r["_ms"] + self.ttl + 1)
                got = [self._token(w["label"], w["digest"], w["sealed"]) for w in r["_wanted"]]
            elif born is not None:
                for token in r["_asked"] or []:
                    if self.sealed.containsKey((token,)):
                        digest, sealed = self.sealed.getValue((token,))
                        known.append(Row(token=token, digest=digest, sealed=sealed))
            yield Row(tenant=key[0], conversation=key[1], at=r["at"], turn=r["turn"], _row=r["_row"], _tokens=got, _known=known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._clear()
        return iter([])

    def close(self) -> None:
        pass


def _aad(digest: Column) -> Column:
    """Ciphertext is bound to tenant, conversation and what it seals; the token is given only in the state."""
    return F.concat_ws("\0", F.col("tenant"), F.col("conversation"), digest)


def scoped(messages: DataFrame, ttl: int = TTL_SECONDS, late: str = "1 minute") -> DataFrame:
    """messages(tenant, conversation, at, turn, _row, _wanted, _asked) through the state. Time is the messages' own: their
    ages do not depend on how a stream is cut into batches. ttl in seconds, 0: for ever."""
    timed = messages.withColumn("_ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("tenant", "conversation").transformWithState(statefulProcessor=Scope(1000 * ttl), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def vault_stream(messages: DataFrame, policy: Policy, key: bytes, hash_key: bytes | None = None, ttl: int = TTL_SECONDS, late: str = "1 minute") -> DataFrame:
    """messages(tenant, conversation, at, turn, kind, text, spans) -> (tenant, conversation, at, turn, kind, text, n,
    entities): those of kind `redact` rewritten under the policy, with tokens of their conversation, those of kind `restore`
    with their known tokens replaced by values. n: values replaced by tokens, or tokens by values.

    Tokens that are unknown, expired, of another tenant or conversation, or tampered with stay as they are. A null text is
    empty; a null tenant or conversation is a scope of its own name, empty; rows without a time are left out, and so are
    those later than the watermark, which Spark drops.
    """
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    lookup = hashlib.sha256(b"pii-vault-lookup" + key).digest()
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = messages.where("at is not null").select(name("tenant"), name("conversation"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("kind", F.lit("redact")).alias("kind"), name("text"), F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS)).alias("spans"))
    value = lambda s: cut(F.col("text"), s["start"], s["end"])
    digest = lambda s: hmac_sha256(lookup, F.concat_ws("\0", s["label"], value(s)))
    # numbers are given from right to left, as a text is rewritten
    used = F.array_sort(F.filter("spans", lambda s: policy.action(s["label"]) == "pseudonymize"), lambda a, b: b["start"] - a["start"])
    wanted = F.transform(used, lambda s: F.struct(s["label"].alias("label"), digest(s).alias("digest"), F.aes_encrypt(value(s).cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)), _aad(digest(s))).alias("sealed")))
    asked = F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    redact = F.col("kind") == "redact"
    # what is needed after the state goes along in the row's own column, so that nothing is joined to a stream
    carried = F.to_json(F.struct("kind", "text", "spans"))
    asking = rows.select("tenant", "conversation", "at", "turn", carried.alias("_row"), F.when(redact, wanted).otherwise(F.array().cast(_WANTED)).cast(_WANTED).alias("_wanted"), F.when(~redact, asked).otherwise(F.array().cast("array<string>")).alias("_asked"))
    out = scoped(asking, ttl, late).withColumn("_m", F.from_json("_row", f"kind string, text string, spans {SPANS}"))
    out = out.select("tenant", "conversation", "at", "turn", "_tokens", "_known", "_m.kind", "_m.text", F.col("_m.spans").alias("spans"))
    made = F.map_from_entries(F.array_distinct(F.zip_with(used, "_tokens", lambda s, t: F.struct(F.concat_ws("\0", s["label"], value(s)), t))))
    out = out.withColumn("_made", made)
    token = lambda s: F.try_element_at(F.col("_made"), F.concat_ws("\0", s["label"], value(s)))
    redacted = replaced(F.col("text"), F.col("spans"), lambda s: replacement(policy, s, value(s), F.col("tenant"), hash_key, token(s)))
    opened = F.transform("_known", lambda k: F.struct(k["token"].alias("token"), F.try_aes_decrypt(k["sealed"], F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), _aad(k["digest"])).cast("string").alias("value")))
    values = F.map_from_entries(F.filter(opened, lambda k: k["value"].isNotNull()))
    hits, pieces = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.split("text", TOKEN, -1)
    known = lambda t: F.try_element_at(F.col("_values"), t)
    restored = F.concat_ws("", F.zip_with(pieces, hits, lambda a, t: F.concat(F.coalesce(a, F.lit("")), F.coalesce(known(t), t, F.lit("")))))
    out = out.withColumn("_values", values)
    n = F.when(redact, F.size("_tokens")).otherwise(F.size(F.filter(hits, lambda t: known(t).isNotNull())))
    return out.select("tenant", "conversation", "at", "turn", "kind", F.when(redact, redacted).otherwise(restored).alias("text"), n.alias("n"), F.when(redact, entities(F.col("spans"), policy)).alias("entities"))
