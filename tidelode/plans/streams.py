"""Queries of keyed state: rewards over batches, resets, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.operators import reward
from tidelode.plans.common import r6, table
from tidelode.plans.rewards import SEED, structures
from tidelode.scratch import Workspace
from tidelode.streaming import keyed

#: Batches that a table arrives in; entries of buffers that these queries keep, few enough to be trimmed.
BATCHES, KEEP_ENERGIES, KEEP_KEYS = 4, 100, 50
#: Attempts at an event, and the first wait.
ATTEMPTS, WAIT_MS = 5, 3_600_000


def _arrivals(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    """The structures of a batch: parts by their keys, cut into equal ranges."""
    most = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("most"))
    rows = structures(spark, sf_dir).join(F.broadcast(most))
    return rows.where(F.least(F.lit(BATCHES - 1), F.floor(F.col("seq") * BATCHES / F.col("most"))) == batch).drop("most").withColumn("reset", F.lit(False))


def _source(session: SparkSession, arrivals: DataFrame, path: str) -> DataFrame:
    return session.readStream.schema(arrivals.schema).parquet(path)


def stream_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of parts that arrive in four batches; the stream is stopped and started again after each of them."""
    work, session = Workspace(spark, "stream-rewards"), keyed.stream_session(spark)
    for batch in range(BATCHES):
        rows = _arrivals(spark, sf_dir, batch)
        rows.write.mode("append").parquet(work.at("arrivals"))
        scored = keyed.reward_stream(_source(session, rows, work.at("arrivals")), reward.Weights(), 0.5, KEEP_ENERGIES, KEEP_KEYS)
        keyed.run_available(scored, work.at("out"), work.at("checkpoint"))
    got = spark.read.parquet(work.at("out"))
    return got.select("seq", "target", "gate_failed", "duplicate_flag", r6("percentile"), r6("r_proxy"), r6("r_total"))


def stream_state_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each target's buffers after two batches, and after a row that resets every second target."""
    work, session = Workspace(spark, "stream-reset"), keyed.stream_session(spark)
    targets = structures(spark, sf_dir).select("target").distinct().where(F.crc32("target") % 2 == 0)
    marks = targets.select("target", F.lit(1 << 40).alias("seq"), F.lit(True).alias("reset"))
    first = _arrivals(spark, sf_dir, 0)
    seen = []
    for when, rows in (("", first), ("before", _arrivals(spark, sf_dir, 1)), ("after", first.limit(0).unionByName(marks, allowMissingColumns=True))):
        rows.write.mode("append").parquet(work.at("arrivals"))
        scored = keyed.reward_stream(_source(session, rows, work.at("arrivals")), reward.Weights(), 0.5, KEEP_ENERGIES, KEEP_KEYS)
        keyed.run_available(scored, work.at("out"), work.at("checkpoint"))
        if when:
            seen.append(work.write(keyed.buffer_sizes(spark, work.at("checkpoint")), when).withColumn("moment", F.lit(when)))
    return seen[0].unionByName(seen[1])


def _settings(key: str) -> dict:
    """Temperature and top-k of a key, drawn from their ranges."""
    return {
        "temperature": F.round(0.7 + 0.5 * keyed.unit_column(SEED, F.col(key), 0), 6),
        "top_k": (F.lit(10) + F.floor(31 * keyed.unit_column(SEED + 1, F.col(key), 0))).cast("int"),
    }


def _succeeds(id_: int, attempt: int, temperature: float, top_k: int) -> bool:
    """Stands for the work itself: cooler attempts succeed more often."""
    return keyed.hashed_unit(SEED, id_, attempt) < 1.0 - 0.5 * temperature


def retry_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work that may fail: every attempt at each, with its own settings and the time when it was due."""
    work, session = Workspace(spark, "retries"), keyed.stream_session(spark)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), *[c.alias(n) for n, c in _settings("event_id").items()])
    # a row far in the future lets the watermark pass all timers
    end = events.agg(F.lit(-1).cast("bigint").alias("id"), (F.max("at") + F.expr("interval 30 days")).alias("at"), F.lit(0.6).alias("temperature"), F.lit(5).alias("top_k"))
    half = F.col("at") < F.lit("2024-01-16").cast("timestamp")
    for rows in (events.where(half), events.where(~half), end):
        rows.write.mode("append").parquet(work.at("arrivals"))
        made = keyed.retry_stream(_source(session, rows, work.at("arrivals")), _succeeds, ATTEMPTS, WAIT_MS)
        keyed.run_available(made, work.at("out"), work.at("checkpoint"))
    return spark.read.parquet(work.at("out")).where("id >= 0").select(F.col("id").alias("event_id"), "attempt", r6("temperature"), "top_k", "due_ms", "ok")


QUERIES = {f.__name__: f for f in (stream_rewards, stream_state_reset, retry_timers)}

#: Structures with their batch, and entries of the energies' buffers: all of a target's first batch, then those that pass.
_BATCHED = f"""
        s as (
          select p_partkey as seq, p_type as target, p_retailprice as e, p_size / 20.0::double as d, p_retailprice / 400.0::double as density, (p_partkey % 14)::double as mean_cn, (p_partkey % 19)::double as max_cn,
                 p_size % 5 = 0 as same, (p_partkey % 100) / 100.0::double as cosine, list_distinct(string_split(p_type, '')) as te, list_distinct(string_split(p_brand, '')) as el,
                 p_brand || '|' || p_size as k, least({BATCHES - 1}, p_partkey * {BATCHES} // (select max(p_partkey) from part)) as batch from part),
        g as (select *, d < 0.5 as gated, min(batch) over (partition by target) as first from s),
        entries as (
          select target, first as batch, 0 as part, seq, e from g where batch = first
          union all select target, batch, 1, seq, e from g where not gated)"""

ORACLE_SQL = {
    "stream_rewards": f"""
        with {_BATCHED},
        starts as (select distinct target, batch, first from g),
        seen as (
          select b.target, b.batch, n.e, row_number() over (partition by b.target, b.batch order by part desc, n.batch desc, seq desc) as age, b.batch = b.first as is_first
          from starts b join entries n on n.target = b.target and (n.part = 0 or n.batch < b.batch)),
        buffer as (select target, batch, e from seen where is_first or age <= {KEEP_ENERGIES}),
        ranked as (
          select g.seq, case when count(*) = 1 then 0.5 else count(*) filter (buffer.e < g.e) / (count(*) - 1) end as pr
          from g join buffer using (target, batch) group by g.seq, g.e),
        passed as (select *, row_number() over (partition by target order by seq) as pos from g where not gated),
        dup as (select seq, (case when pos - lag(pos) over (partition by target, k order by seq) <= {KEEP_KEYS} then 1 else 0 end)::int as dup from passed),
        parts as (
          select seq, target, gated, dup, pr, 1 - least(0.95, greatest(0.05, pr)) as r_proxy,
                 (least(1, greatest(0, (d - 0.5) / 0.8)) + least(1, greatest(0, 1 - abs(ln(greatest(density, 1e-8) / 3.5)) / 1.5)) + case when mean_cn < 1 or mean_cn > 12 or max_cn > 16 then 0 else 1 end) / 3 as r_geom,
                 case when same then 1.0 else least(1, greatest(0, cosine - (0.35 * len(list_filter(te, lambda x: not list_contains(el, x))) / len(te) + 0.25 * len(list_filter(el, lambda x: not list_contains(te, x))) / len(el)))) end as r_comp
          from g join ranked using (seq) left join dup using (seq))
        select seq, target, gated::int as gate_failed, dup as duplicate_flag, round(pr, 6) as percentile, case when not gated then round(r_proxy, 6) end as r_proxy,
               case when gated then -1.0 else round(least(1, greatest(0, 0.7::double * r_proxy + 0.1::double * r_geom + 0.1::double * r_comp + 0.1::double * (1 - dup))), 6) end as r_total
        from parts""",
    # crc32 of the target by its bits tells which ones were reset
    "stream_state_reset": f"""
        with {_BATCHED},
        arrived as (select * from entries where batch <= 1),
        sizes as (
          select target, least({KEEP_ENERGIES}, count(*)) as energies, least({KEEP_KEYS}, count(*) filter (part = 1)) as keys,
                 xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(target, ''), lambda x: ascii(x)::bigint)),
                   lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 2 as kept
          from arrived group by target)
        select target, energies, keys, 'before' as moment from sizes union all select target, energies, keys, 'after' from sizes where kept = 1""",
    "retry_timers": f"""
        with recursive drawn as (
          select event_id, epoch_us(ts) // 1000 as arrived, round(0.7::double + 0.5::double * (('0x' || substr(md5('{SEED}|' || event_id || '|0'), 1, 8))::bigint / 4294967296.0::double), 6) as temperature,
                 (10 + floor(31::double * (('0x' || substr(md5('{SEED + 1}|' || event_id || '|0'), 1, 8))::bigint / 4294967296.0::double)))::int as top_k from events),
        made(event_id, attempt, temperature, top_k, due_ms, ok) as (
          select event_id, 1, temperature, top_k, arrived, ('0x' || substr(md5('{SEED}|' || event_id || '|1'), 1, 8))::bigint / 4294967296.0::double < 1.0::double - 0.5::double * temperature from drawn
          union all
          select event_id, attempt + 1, greatest(0.6::double, temperature * 0.8::double), greatest(5, top_k // 2)::int, due_ms + {WAIT_MS} * (1 << (attempt - 1)),
                 ('0x' || substr(md5('{SEED}|' || event_id || '|' || (attempt + 1)), 1, 8))::bigint / 4294967296.0::double < 1.0::double - 0.5::double * greatest(0.6::double, temperature * 0.8::double)
          from made where not ok and attempt < {ATTEMPTS})
        select event_id, attempt, round(temperature, 6) as temperature, top_k, due_ms, ok from made""",
}
