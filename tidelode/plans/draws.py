"""Queries of draws, cursors, observed writes and tables laid out by key."""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions import logits as L
from tidelode.operators import joins, ranking, sampling
from tidelode.plans.common import r6, table
from tidelode.plans.rewards import SEED
from tidelode.scratch import Workspace
from tidelode.streaming.keyed import unit_column

#: Draws from each vector's logits; the vocabulary is smaller than the vectors. Buckets of tables laid out by key.
DRAWS, VOCABULARY, BUCKETS = 3, 60, 8
#: The steps of training that the cursor's query reads: two epochs and a half, from the middle of the first.
FIRST_EPOCH, EPOCHS = 0.5, 2.5


def token_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens drawn from vectors as logits, each with a temperature and top-k of its own."""
    key = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", L.masked(F.transform("embedding", lambda x: x.cast("double") * 20), VOCABULARY).alias("logits"),
        F.round(0.6 + 0.6 * unit_column(SEED, key, 7), 6).alias("temperature"), F.floor(41 * unit_column(SEED, key, 8)).cast("int").alias("k"),
    )
    rows = rows.withColumn("kept", L.top_k(F.col("logits"), F.col("k"))).withColumn("p", L.softmax(F.col("kept"), F.col("temperature")))
    own = L.sigmoid_top_k(F.col("logits"), F.col("k"))
    rows = rows.withColumns({"n_kept": F.size(F.filter("kept", lambda x: x.isNotNull())), "sigmoids": F.aggregate(own, F.lit(0.0), lambda t, x: t + x), "draw": F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))})
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("token"), key, "draw")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.select("vec_id", "draw", "k", "n_kept", r6(F.array_max("p"), "p_best"), r6("sigmoids"), L.drawn(F.col("p"), uniform).alias("token"))


def _steps(n: int, epochs: float) -> int:
    """The steps of so many epochs of n rows; a half is rounded up, as the cast of a decimal does in SQL."""
    return int((n * Decimal(str(epochs))).to_integral_value(ROUND_HALF_UP))


def epoch_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that training reads from the middle of its first epoch to the end of the third."""
    work = Workspace(spark, "cursor")
    numbered = ranking.placed(table(spark, sf_dir, "documents").select("doc_id"), [], [F.col("doc_id").isNull(), "doc_id"]).select("doc_id", (F.col("place") - 1).alias("number"))
    numbered = work.write(numbered, "numbered")
    n = numbered.count()
    rows = sampling.epoch_rows(numbered, "number", n, SEED, _steps(n, FIRST_EPOCH), _steps(n, EPOCHS))
    return rows.select("step", "epoch", "position", "doc_id")


def observed_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the writer of candidates saw pass, and how many rows it wrote."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("valid"), (F.col("n_chars") > 100).alias("hit_target"))
    labels = table(spark, sf_dir, "labels")
    rewards = labels.select("doc_id", F.when(F.col("toxic") == 1, -1.0).otherwise(1.0).alias("reward"), (1 - F.col("quality")).alias("gate_failed"))
    scores = labels.where("quality = 1 or toxic = 1").select("doc_id", F.col("quality").alias("score"))
    rows = joins.candidate_reasons(docs, scores, rewards, "doc_id", F.col("valid"), "score", "reward", "gate_failed")
    work = Workspace(spark, "observed")
    counts = joins.write_candidates(rows, work.at("candidates"))
    written = spark.read.parquet(work.at("candidates")).agg(F.count("*").alias("written"))
    return written.select(*[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()], "written")


def bucketed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with label and reward, joined without an exchange: the three tables were written by their key."""
    work, mark = Workspace(spark, "bucketed"), uuid.uuid4().hex
    lay = lambda df, name: joins.write_by_key(df, f"{name}_{mark}", work.at(name), "doc_id", BUCKETS)
    docs = lay(table(spark, sf_dir, "documents").select("doc_id", "lang"), "docs")
    labels = lay(table(spark, sf_dir, "labels"), "labels")
    rewards = lay(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("reward")), "rewards")
    rows = docs.join(labels.hint("merge"), "doc_id", "left").join(rewards.hint("merge"), "doc_id", "left")
    gated = F.coalesce(F.col("quality") == 0, F.lit(False))
    return rows.select("doc_id", "lang", "quality", "toxic", F.when(gated, -1.0).otherwise(F.coalesce("reward", F.lit(-1.0))).alias("r_total"))


QUERIES = {f.__name__: f for f in (token_draws, epoch_cursor, observed_drops, bucketed_candidates)}

_UNIT = "(('0x' || substr(md5({0}), 1, 8))::bigint / 4294967296.0::double)"
_FEISTEL = """list_reduce(list_concat([{0}], keys), lambda v, k:
                 ((v & side) << half) + xor(v >> half, (((v & side) * (v & side) + k) % 2147483648 * 1103515245 >> 15) & side))"""

ORACLE_SQL = {
    "token_draws": f"""
        with e as (
          select vec_id, list_transform(embedding[1:{VOCABULARY}], lambda x: x::double * 20) as logits, round(0.6::double + 0.6::double * {_UNIT.format(f"'{SEED}|' || vec_id || '|7'")}, 6) as t,
                 floor(41::double * {_UNIT.format(f"'{SEED}|' || vec_id || '|8'")})::int as k from embeddings),
        cut as (select *, case when k >= 1 and k < len(logits) then list_reverse_sort(logits)[k] else list_min(logits) end as kth, list_max(logits) as most from e),
        w as (
          select *, list_transform(logits, lambda x: case when x >= kth then exp((x - most) / t) else 0.0::double end) as w,
                 list_sum(list_transform(logits, lambda x: case when x >= kth then 1 / (1 + exp(-x)) else 0.0::double end)) as sigmoids from cut),
        p as (select vec_id, k, sigmoids, list_transform(w, lambda x: x / list_sum(w)) as p from w),
        c as (
          select vec_id, draw, k, sigmoids, p, {_UNIT.format("'token|' || vec_id || '|' || draw")} as u, list_transform(range(1, len(p) + 1), lambda i: list_sum(p[1:i])) as upto
          from p, unnest(range({DRAWS})) as t(draw))
        select vec_id, draw::int as draw, k, len(list_filter(p, lambda x: x > 0))::int as n_kept, round(list_max(p), 6) as p_best, round(sigmoids, 6) as sigmoids,
               (len(list_filter(upto, lambda x: x <= u)))::int as token from c""",
    "epoch_cursor": f"""
        with numbered as (select doc_id, row_number() over (order by doc_id) - 1 as number from documents),
        size as (select count(*) as n, greatest(1, ceil(log2(greatest(count(*), 2)) / 2))::bigint as half from numbered),
        steps as (select unnest(range((n * {FIRST_EPOCH})::bigint, (n * {FIRST_EPOCH})::bigint + (n * {EPOCHS})::bigint)) as step, n, half, (1::bigint << half) - 1 as side from size),
        keyed as (
          select *, step // n as epoch, step % n as position,
                 list_transform(range({sampling.ROUNDS}), lambda r: ('0x' || substr(md5('{SEED}|' || (step // n) || '|' || r), 1, 7))::bigint) as keys from steps),
        walked as (
          select *, list_reduce(list_concat([{_FEISTEL.format("position")}], range({sampling.WALKS})), lambda v, z: case when v < n then v else {_FEISTEL.format("v").replace("lambda v, k", "lambda w, k").replace("(v &", "(w &").replace("xor(v >>", "xor(w >>")} end) as number
          from keyed)
        select step, epoch, position, doc_id from walked join numbered using (number)""",
    "observed_drops": """
        with rows_ as (
          select case when not (d.lang = 'en' and d.n_chars > 100) then 'invalid_or_mismatch'
                      when l.doc_id is null or not (l.quality = 1 or l.toxic = 1) then 'missing_score'
                      when l.quality = 0 then 'gate_failed'
                      when l.toxic = 1 then 'negative_reward' end as reason
          from documents d left join labels l using (doc_id))
        select count(*) as total, count(*) filter (reason is null) as kept, count(*) filter (reason = 'invalid_or_mismatch') as invalid_or_mismatch, count(*) filter (reason = 'missing_score') as missing_score,
               0::bigint as missing_reward, count(*) filter (reason = 'gate_failed') as gate_failed, count(*) filter (reason = 'negative_reward') as negative_reward, count(*) filter (reason is null) as written from rows_""",
    "bucketed_candidates": """
        select d.doc_id, d.lang, l.quality, l.toxic, case when l.quality = 0 then -1.0::double else coalesce(e.reward, -1.0::double) end as r_total
        from documents d left join labels l using (doc_id)
        left join (select user_id as doc_id, max(value) as reward from events group by user_id) e using (doc_id)""",
}
