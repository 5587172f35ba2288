"""Queries of the gateway over the driver's tables, with their SQL: admission, the vault as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.functions import phones
from opalspan.functions import spans as sp
from opalspan.functions.policy import policy
from opalspan.operators import limiter, values
from opalspan.plans.oracle import _DIGITS, _TURN_WORDS, _hits
from opalspan.plans.queries import KEY, documents, table
from opalspan.sources.shared import scratch


def q_admitted(visitor: str, window: int, limit: int, cap: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select("event_id", visitor, "ts")
        return limiter.limited(events, visitor, "ts", "event_id", window, limit, cap).select("event_id", "verdict")

    return run


def sql_admitted(visitor: str, window: int, limit: int, cap: int) -> str:
    """Request by request."""
    return f"""
with recursive e as materialized (select row_number() over (order by ts, event_id) as i, event_id, coalesce(cast({visitor} as varchar), chr(0)) as who, epoch_us(ts) as t, epoch_us(ts) // 86400000000 as d from events where ts is not null),
r as (select 0::bigint as i, null::bigint as event_id, null::varchar as verdict, -1::bigint as d, 0::bigint as n, []::struct(who varchar, t bigint)[] as hits
  union all select i, event_id, verdict, d, case when verdict = 'admitted' then n + 1 else n end, case when verdict = 'admitted' then list_append(live, {{'who': who, 't': t}}) else live end
  from (select *, case when n >= {cap} then 'daily' when len(list_filter(live, lambda h: h.who = who)) >= {limit} then 'window' else 'admitted' end as verdict
    from (select e.i, e.event_id, e.who, e.t, e.d, case when r.d = e.d then r.n else 0 end as n, list_filter(r.hits, lambda h: e.t - h.t <= {window}000000) as live from r join e on e.i = r.i + 1) as x) as y)
select event_id, verdict from r where event_id is not null union all select event_id, null from events where ts is null
"""


def q_vault_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream, an hour a turn, scopes of two hours; after each turn its first three tokens are asked
    for."""
    from opalspan.streaming.vault import vault_stream

    path = scratch(spark, "vault-stream")
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*").select(F.lit("t1").alias("tenant"), F.col("conv_id").cast("string").alias("conversation"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600).alias("at"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    words = turns.withColumn("spans", sp.matches(F.col("text"), r"(?U)\b\p{Lu}\p{Ll}{3,}\b", "GIVENNAME", "gold"))
    asked = F.lit("|".join(f"<GIVENNAME_{n}>" for n in (1, 2, 3)))
    kinds = F.array(F.struct(F.lit("redact").alias("kind"), (2 * F.col("turn")).alias("turn"), F.col("text").alias("text"), F.col("spans").alias("spans")), F.struct(F.lit("restore").alias("kind"), (2 * F.col("turn") + 1).alias("turn"), asked.alias("text"), sp.no_spans().alias("spans")))
    rows = words.select("tenant", "conversation", "at", F.explode(kinds).alias("m")).select("tenant", "conversation", "at", "m.*")
    # the watermark allows for turns of a conversation in any order
    out = vault_stream(rows, policy("analytics"), KEY, ttl=2 * 3600, late="365 days").select("conversation", "turn", "kind", F.when(F.col("kind") == "restore", F.col("text")).alias("restored"), F.col("n").cast("long").alias("n"))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


_VAULT_STREAM = rf"""
with recursive {_TURN_WORDS}, names as (select conv_id, turn, s, value from said where regexp_full_match(value, '\p{{Lu}}\p{{Ll}}{{3,}}')),
t as materialized (select conv_id, turn, row_number() over (partition by conv_id order by turn) as i, exists (select 1 from names n where n.conv_id = c.conv_id and n.turn = c.turn) as named from conversations c),
life as (select conv_id, turn, i, case when named then turn end as born from t where i = 1
  union all select t.conv_id, t.turn, t.i, case when life.born is not null and t.turn - life.born <= 2 then life.born when t.named then t.turn end from life join t on t.conv_id = life.conv_id and t.i = life.i + 1),
firsts as (select conv_id, born, value, min((turn, -s)) as first, min(turn) as since from names join life using (conv_id, turn) group by all),
known as (select *, row_number() over (partition by conv_id, born order by first) as n from firsts)
select cast(conv_id as varchar) as conversation, 2 * turn as turn, 'redact' as kind, null as restored, (select count(*) from names n where n.conv_id = life.conv_id and n.turn = life.turn) as n from life
union all
select cast(conv_id as varchar), 2 * turn + 1, 'restore', coalesce(max(value) filter (n = 1), '<GIVENNAME_1>') || '|' || coalesce(max(value) filter (n = 2), '<GIVENNAME_2>') || '|' || coalesce(max(value) filter (n = 3), '<GIVENNAME_3>'), count(value) filter (n <= 3)
from (select life.conv_id, life.turn, k.value, k.n from life left join known k on k.conv_id = life.conv_id and k.born = life.born and k.since <= life.turn) group by all
"""

def q_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in documents, and in a sentence for each customer: of eight ways to write one, whole or wrong by the key."""
    k = F.col("c_custkey")
    part = lambda by, low, n: (F.lit(low) + (k * by) % n).cast("string")
    line = F.lpad(part(37, 0, 10_000), 4, "0")
    ways = [
        F.concat(F.lit("+1 "), part(7, 200, 800), F.lit(" "), part(11, 100, 900), F.lit(" "), line),
        F.concat(F.lit("("), part(13, 200, 800), F.lit(") "), part(3, 200, 800), F.lit("-"), line),
        F.concat(F.lit("0"), part(17, 10, 90), F.lit(" "), part(5, 1000, 9000), F.lit(" "), line),
        F.concat(F.lit("+44 "), part(19, 1000, 9000), F.lit(" "), part(5, 100_000, 900_000)),
        F.concat(part(23, 10_000, 90_000), F.lit(" "), part(29, 10_000, 90_000)),
        F.concat(F.lit("+91-"), part(31, 10_000, 90_000), F.lit("-"), part(41, 10_000, 90_000)),
        F.concat(F.lit("00"), part(43, 10, 90), F.lit(" "), part(47, 100_000, 900_000), F.lit(" "), part(53, 10, 990)),
        F.concat(F.lit("011 "), part(59, 10, 90), F.lit(" "), part(61, 1000, 9000), F.lit(" "), part(67, 1000, 9000)),
    ]
    said = F.concat(F.lit("Call "), F.element_at(F.array(*ways), (k % len(ways) + 1).cast("int")), F.lit(" please"))
    rows = documents(spark, sf_dir).select("doc_id", "text").unionByName(table(spark, sf_dir, "customer").select((-1 - k).alias("doc_id"), said.alias("text")))
    found = rows.select("doc_id", F.explode(phones.phones_by_plan(F.col("text"))).alias("s")).withColumn("r", phones.read(F.col("s.text")))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.text").alias("value"), "r.number", "r.region", "r.kind")


def _part(by: int, low: int, n: int) -> str:
    return f"cast({low} + (c_custkey * {by}) % {n} as varchar)"


_LINE = f"lpad({_part(37, 0, 10_000)}, 4, '0')"
_WAYS = [
    f"'+1 ' || {_part(7, 200, 800)} || ' ' || {_part(11, 100, 900)} || ' ' || {_LINE}",
    f"'(' || {_part(13, 200, 800)} || ') ' || {_part(3, 200, 800)} || '-' || {_LINE}",
    f"'0' || {_part(17, 10, 90)} || ' ' || {_part(5, 1000, 9000)} || ' ' || {_LINE}",
    f"'+44 ' || {_part(19, 1000, 9000)} || ' ' || {_part(5, 100_000, 900_000)}",
    f"{_part(23, 10_000, 90_000)} || ' ' || {_part(29, 10_000, 90_000)}",
    f"'+91-' || {_part(31, 10_000, 90_000)} || '-' || {_part(41, 10_000, 90_000)}",
    f"'00' || {_part(43, 10, 90)} || ' ' || {_part(47, 100_000, 900_000)} || ' ' || {_part(53, 10, 990)}",
    f"'011 ' || {_part(59, 10, 90)} || ' ' || {_part(61, 1000, 9000)} || ' ' || {_part(67, 1000, 9000)}",
]
_READINGS = ", ".join(x for code, before, must, abroad in phones.REGIONS.values() for x in (f"case when starts_with(d, '{abroad}') then d[{len(abroad) + 1}:] end", f"case when starts_with(d, '{before}') then '{code}' || d[{len(before) + 1}:] end", *([] if must else [f"'{code}' || d"])))
#: The longest prefix by a join.
_PHONES = rf"""
with docs as (select doc_id, coalesce(text, '') as text from documents union all select -1 - c_custkey, 'Call ' || case c_custkey % {len(_WAYS)} {' '.join(f'when {i} then {w}' for i, w in enumerate(_WAYS))} end || ' please' from customer),
hits as ({_hits('TELEPHONENUM')}),
c as (select doc_id, cast(start_at as bigint) as start_at, cast(start_at + len(value) as bigint) as end_at, value, {_DIGITS} as d from hits
  where not regexp_matches(case when start_at = 0 then '' else substr(text, cast(start_at as bigint), 1) end, '[\pL\pN_.+]') and not regexp_matches(substr(text, cast(start_at + len(value) + 1 as bigint), 1), '[\pL\pN_-]')),
tried as (select *, case when value[1] = '+' then [d] else list_filter([{_READINGS}], lambda x: x is not null) end as numbers from c),
each as (select doc_id, start_at, end_at, value, numbers[i] as number, i from tried, unnest(range(1, len(numbers) + 1)) as u(i)),
plan(prefix, low, high, kind, region) as (values {', '.join(map(repr, phones.plan()))}),
longest as (select * from each join plan on starts_with(number, prefix) qualify row_number() over (partition by doc_id, start_at, i order by len(prefix) desc) = 1),
sized as (select *, len(number) - case when number[1:3] in ({', '.join(repr(c) for c in phones.ABROAD if len(c) == 3)}) then 3 when number[1:2] in ('44', '91', {', '.join(repr(c) for c in phones.ABROAD if len(c) == 2)}) then 2 else 1 end as n from longest),
good as (select * from sized where len(number) > len(prefix) and n between low and high and (number[1] <> '1' or regexp_matches(number[5:7], '^[2-9][0-9]{{2}}$') and number[6:7] <> '11'))
select doc_id, start_at, end_at, value, number, region, kind from good qualify row_number() over (partition by doc_id, start_at order by i) = 1
"""

_PHRASE = r"^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"


def q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts, and the first three words of benchmark items, found in documents."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("value")).agg(F.min("p_partkey").alias("value_id"))
    items = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", _PHRASE, 0).alias("value"), (-1 - F.col("item_id")).alias("value_id"))
    return values.found_values(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", names.unionByName(items)).select("doc_id", "value_id", F.col("start").cast("long").alias("start_at"))


_VALUES = rf"""
with v as (select lower(value) as value, value_id from (select p_name as value, min(p_partkey) as value_id from part group by p_name union all select regexp_extract(text, '{_PHRASE}'), -1 - item_id from benchmark) where value <> ''),
d as (select doc_id, lower(coalesce(text, '')) as text from documents),
h as (select doc_id, value_id, value, text, string_split(text, value) as a from d join v on contains(text, value)),
p as (select doc_id, value_id, value, text, cast(list_sum(list_transform(a[1:i], lambda x: len(x))) + (i - 1) * len(value) as bigint) as start_at from h, unnest(range(1, len(a))) as u(i))
select doc_id, value_id, start_at from p where not (start_at > 0 and regexp_matches(text[start_at], '[\pL\pN_]')) and not regexp_matches(text[start_at + len(value) + 1], '[\pL\pN_]')
"""

#: Name -> (query, its SQL or None).
GATEWAY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "limiter_admitted": (q_admitted("event_type", 3600, 2, 150), sql_admitted("event_type", 3600, 2, 150)),
    "limiter_admitted_users": (q_admitted("user_id", 60, 10, 300), sql_admitted("user_id", 60, 10, 300)),
    "vault_stream": (q_vault_stream, _VAULT_STREAM),
    "phones_by_plan": (q_phones, _PHONES),
    "values_in_documents": (q_values, _VALUES),
}
