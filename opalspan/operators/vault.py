"""Reversible tokens: numbering per conversation, authenticated encryption, restoring, expiry."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalspan.functions.policy import Policy, entities, hmac_sha256, replacement
from opalspan.functions.spans import SPANS, cut, replaced

TTL_SECONDS = 24 * 3600
TOKEN = r"<[A-Z]+_[0-9]+>"


def _aad(tenant: Column, conversation: Column, token: Column) -> Column:
    return F.concat_ws("\0", tenant.cast("string"), conversation.cast("string"), token)


def tokens(spans: DataFrame, key: bytes, created: Column | None = None, iv: Column | None = None) -> DataFrame:
    """spans(tenant, conversation, turn, start, label, value) -> the vault: one row per different value of a label in a
    conversation, with its number, token, digest and ciphertext.

    Numbers follow first sight: earlier turns first, and within a text from right to left, as it is rewritten. The
    ciphertext is bound to tenant, conversation and token; a random nonce each time unless iv gives one (tests).
    """
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    lookup = hashlib.sha256(b"pii-vault-lookup" + key).digest()
    scope = ["tenant", "conversation", "label"]
    first = spans.groupBy(*scope, "value").agg(F.min(F.struct("turn", (-F.col("start")).alias("at"))).alias("first"))
    n = F.row_number().over(Window.partitionBy(*scope).orderBy("first.turn", "first.at"))
    named = first.withColumn("n", n).withColumn("token", F.concat(F.lit("<"), "label", F.lit("_"), F.col("n").cast("string"), F.lit(">")))
    sealed = F.aes_encrypt(F.col("value").cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), iv if iv is not None else F.unhex(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)), _aad(F.col("tenant"), F.col("conversation"), F.col("token")))
    digest = hmac_sha256(lookup, F.concat_ws("\0", "label", "value"))
    return named.select(*scope, "n", "token", digest.alias("digest"), sealed.alias("ciphertext"), (created if created is not None else F.current_timestamp()).alias("created"))


def pseudonymised(messages: DataFrame, policy: Policy, key: bytes, hash_key: bytes | None = None, created: Column | None = None, iv: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """messages(tenant, conversation, turn, text, spans) -> (the messages with redacted and entities; the vault).

    Only the spans are exploded and shuffled to number them; a message gets its own tokens back as a map.
    """
    used = messages.select("tenant", "conversation", "turn", "text", F.explode("spans").alias("s")).where(policy.action(F.col("s.label")) == "pseudonymize")
    flat = used.select("tenant", "conversation", "turn", F.col("s.start").alias("start"), F.col("s.label").alias("label"), cut(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"))
    vault = tokens(flat, key, created, iv)
    lookup = hashlib.sha256(b"pii-vault-lookup" + key).digest()
    digests = flat.withColumn("digest", hmac_sha256(lookup, F.concat_ws("\0", "label", "value")))
    own = digests.join(vault.select("tenant", "conversation", "label", "digest", "token"), ["tenant", "conversation", "label", "digest"])
    maps = own.groupBy("tenant", "conversation", "turn").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "label", "value"), "token"))).alias("_tokens"))
    both = messages.join(maps, ["tenant", "conversation", "turn"], "left")
    token = lambda s, v: F.try_element_at(F.col("_tokens"), F.concat_ws("\0", s["label"], v))

    def by(s: Column) -> Column:
        value = cut(F.col("text"), s["start"], s["end"])
        return replacement(policy, s, value, F.col("tenant"), hash_key, token(s, value))

    out = both.withColumn("redacted", replaced(F.col("text"), F.col("spans").cast(SPANS), by)).withColumn("entities", entities(F.col("spans"), policy))
    return out.drop("_tokens"), vault


def restored(messages: DataFrame, vault: DataFrame, key: bytes, now: Column | None = None, ttl: int = TTL_SECONDS) -> DataFrame:
    """messages(tenant, conversation, turn, text) with restored and n_restored. Tokens that are unknown, expired, of
    another conversation or tampered with stay as they are."""
    live = live_scopes(vault, now, ttl)
    wanted = messages.select("tenant", "conversation", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    value = F.try_aes_decrypt(F.col("ciphertext"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), _aad(F.col("tenant"), F.col("conversation"), F.col("token"))).cast("string")
    found = wanted.join(live, ["tenant", "conversation", "token"]).withColumn("value", value).where("value is not null")
    maps = found.groupBy("tenant", "conversation", "turn").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))
    both = messages.join(maps, ["tenant", "conversation", "turn"], "left").withColumn("_values", F.coalesce("_values", F.create_map().cast("map<string,string>")))
    pieces, hits = F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    known = lambda t: F.try_element_at(F.col("_values"), t)
    text = F.concat_ws("", F.zip_with(pieces, hits, lambda a, t: F.concat(F.coalesce(a, F.lit("")), F.coalesce(known(t), t, F.lit("")))))
    return both.withColumn("restored", text).withColumn("n_restored", F.size(F.filter(hits, lambda t: known(t).isNotNull()))).drop("_values")


def live_scopes(vault: DataFrame, now: Column | None = None, ttl: int = TTL_SECONDS) -> DataFrame:
    """Rows of conversations whose first token is no older than ttl seconds."""
    now = F.current_timestamp() if now is None else now
    born = vault.groupBy("tenant", "conversation").agg(F.min("created").alias("_born"))
    live = born.where(F.unix_timestamp(now) - F.unix_timestamp("_born") <= ttl)
    return vault.join(live.select("tenant", "conversation"), ["tenant", "conversation"], "left_semi")


def purged(vault: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Conversations that have expired."""
    born = vault.groupBy("tenant", "conversation").agg(F.min("created").alias("created"))
    return born.where(F.unix_timestamp(now) - F.unix_timestamp("created") > ttl)


def proxied(messages: DataFrame, policy: Policy, key: bytes, upstream, hash_key: bytes | None = None, created: Column | None = None) -> DataFrame:
    """Redacts every message, gives the redacted text to upstream(column) -> column, and restores its reply."""
    safe, vault = pseudonymised(messages, policy, key, hash_key, created)
    replies = safe.select("tenant", "conversation", "turn", upstream(F.col("redacted")).alias("text"))
    return restored(replies, vault, key, created).withColumnRenamed("text", "reply")


def limited(events: DataFrame, key: str, at: str, per_minute: int, per_day: int) -> DataFrame:
    """events with allowed: fewer than per_minute earlier ones of the key within 60 seconds, fewer than per_day that
    UTC day. Counts are of requests, allowed or not."""
    sec = F.unix_timestamp(at)
    minute = Window.partitionBy(key).orderBy(F.col("_sec")).rangeBetween(-59, 0)
    day = Window.partitionBy(key, F.to_date(at)).orderBy(F.col("_sec")).rangeBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_sec", sec).withColumn("in_minute", F.count(F.lit(1)).over(minute)).withColumn("in_day", F.count(F.lit(1)).over(day))
    return counted.withColumn("allowed", (F.col("in_minute") <= per_minute) & (F.col("in_day") <= per_day)).drop("_sec")
