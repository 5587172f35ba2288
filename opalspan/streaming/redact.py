"""Streams: stateless redaction, tokens kept by conversation, a rate limiter."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from opalspan.functions.policy import Policy
from opalspan.plans.redaction import redact

#: State needs this provider: spark.sql.streaming.stateStore.providerClass.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def redact_stream(messages: DataFrame, policy: Policy, hash_key: bytes | None = None, limit: int | None = None) -> DataFrame:
    """The batch redaction on a stream of (key, text): no state, append mode."""
    return redact(messages, policy, hash_key=hash_key, limit=limit)


class TokenState(StatefulProcessor):
    """Per tenant and conversation: a value's token by its keyed digest, the last number of each label, and when the first
    one was made. All of it goes together once that is longer ago than the time to live, by the clock. Rows of a batch
    come in no order, so they are taken by turn, and within a text from right to left. (streaming.vault keeps ciphertexts
    too, and goes by the messages' own time.)"""

    def __init__(self, key: bytes, ttl_ms: int) -> None:
        self.mac, self.ttl = hashlib.sha256(b"pii-vault-lookup" + key).digest(), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = StructType([StructField("v", StringType())])
        self.handle = handle
        self.created = handle.getValueState("created", StructType([StructField("ms", LongType())]))
        self.by_digest = handle.getMapState("tokens", one, one)
        self.counters = handle.getMapState("counters", one, one)

    def _clear(self) -> None:
        for state in (self.created, self.by_digest, self.counters):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows)).sort_values(["turn", "start"], ascending=[True, False])
        if self.ttl:
            now = timerValues.getCurrentProcessingTimeInMs()
            if self.created.exists() and now - self.created.get()[0] > self.ttl:
                self._clear()
            if not self.created.exists():
                self.created.update((now,))
                self.handle.registerTimer(now + self.ttl + 1)
        out = []
        for r in whole.itertuples():
            digest = hmac.new(self.mac, f"{r.label}\0{r.value}".encode(), "sha256").hexdigest()
            got = self.by_digest.getValue((digest,)) if self.by_digest.containsKey((digest,)) else None
            if got is None:
                last = self.counters.getValue((r.label,)) if self.counters.containsKey((r.label,)) else None
                n = int(last[0]) + 1 if last else 1
                self.counters.updateValue((r.label,), (str(n),))
                got = (f"<{r.label}_{n}>",)
                self.by_digest.updateValue((digest,), got)
            out.append((key[0], key[1], r.turn, r.start, r.label, got[0]))
        yield pd.DataFrame(out, columns=["tenant", "conversation", "turn", "start", "label", "token"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.created.exists() and timerValues.getCurrentProcessingTimeInMs() - self.created.get()[0] > self.ttl:
            self._clear()
        return iter([])

    def close(self) -> None:
        pass


def token_stream(spans: DataFrame, key: bytes, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """spans(tenant, conversation, turn, start, label, value) -> (tenant, conversation, turn, start, label, token). Spans
    without a tenant are all of one."""
    spans = spans if "tenant" in spans.columns else spans.withColumn("tenant", F.lit("default"))
    return spans.groupBy("tenant", "conversation").transformWithStateInPandas(
        statefulProcessor=TokenState(key, ttl_ms), outputStructType="tenant string, conversation string, turn long, start int, label string, token string", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def limiter_stream(events: DataFrame, key: str, at: str, late: str = "1 minute") -> DataFrame:
    """Requests per key in sliding minutes, for a limiter that reads the result; late events count until the
    watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, "60 seconds", "10 seconds"), key).agg(F.count(F.lit(1)).alias("n"))
