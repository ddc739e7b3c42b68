"""Queries of rewards and pairs: ranks, novelty, components, pools, pairs, allocation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions import expressions as E
from tidelode.operators import ranking, reward, sampling, stats
from tidelode.plans.common import r6, table
from tidelode.plans.evaluation import UNIT_PRICES

SEED = 42


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")


def percentile_rank_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's percentile in its type, and the proxy reward of it."""
    rows = ranking.percentile_rank(_events(spark, sf_dir), ["event_type"], "value")
    return rows.select("event_id", r6("pr"), r6(E.r_proxy(F.col("pr")), "r_proxy"))


def percentile_rank_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the tenth of January on ranked among those before."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    late = F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")
    rows = ranking.percentile_rank_in(events.where(late), events.where(~late), ["event_type"], "value")
    return rows.select("event_id", r6("pr"))


def novelty_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type and user occurred among the 200 before."""
    rows = _events(spark, sf_dir).select("event_id", F.lit("all").alias("target"), F.concat_ws("|", "event_type", "user_id").alias("key"))
    return ranking.duplicate_in_window(rows, ["target"], "key", ["event_id"], 200).select("event_id", "duplicate_flag")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structures: features by their size, price and keys."""
    k = F.col("p_partkey")
    letters = lambda name: F.array_distinct(F.split(F.col(name), ""))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("target"),
        k.alias("seq"),
        F.col("p_retailprice").alias("e_per_atom"),
        (F.col("p_size") / 20.0).alias("min_distance"),
        (F.col("p_retailprice") / 400.0).alias("density"),
        F.lit(3.5).alias("ref_density"),
        (k % 14).cast("double").alias("mean_cn"),
        (k % 19).cast("double").alias("max_cn"),
        (F.col("p_size") % 5 == 0).alias("same"),
        ((k % 100) / 100.0).alias("cosine"),
        letters("p_type").alias("target_elements"),
        letters("p_brand").alias("elements"),
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("struct_key"),
    )


def composite_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their reward components, gated by a shortest distance."""
    rows = reward.composite(structures(spark, sf_dir), reward.Weights(), least_distance=0.5, window=50)
    return rows.select("seq", "target", "gate_failed", "gate_reason", "duplicate_flag", *[r6(c) for c in ("r_proxy", "r_geom", "r_comp", "r_novel", "r_total")])


def reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts, rates and statistics of these rewards."""
    rows = reward.summary(reward.composite(structures(spark, sf_dir), reward.Weights(), least_distance=0.5, window=50))
    return rows.select("n_structures", "n_gate_passed", r6("gate_failure_rate"), r6("duplicate_rate"), *[r6(f"r_total.{k}", f"total_{k}") for k in ("mean", "std", "p05", "p50", "p95")])


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("reward"))
    return ranking.pools(docs, ["lang"], "reward", ["doc_id"], 0.1, 0.1)


def top_bottom_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language in the top and bottom tenth by length."""
    return _pools(spark, sf_dir).where("in_top or in_bottom").select("doc_id", "lang", "in_top", "in_bottom")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.preference_pairs(_pools(spark, sf_dir), "lang", "doc_id", "reward", 1000.0, 300, SEED)


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 300 pairs a language with a length gap of 1000, in hash order."""
    return _pairs(spark, sf_dir).select("lang", "chosen_doc_id", "rejected_doc_id", "chosen_reward", "rejected_reward")


def pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the gaps of these pairs, and pairs a language."""
    pairs = _pairs(spark, sf_dir).withColumn("gap", F.col("chosen_reward") - F.col("rejected_reward"))
    per = stats.counts_per(pairs, "lang").select("groups", r6("mean", "mean_pairs"), "least", "most", r6("std", "std_pairs"))
    gaps = stats.gap_stats(pairs, "gap")
    return gaps.select("n", *[r6(c) for c in gaps.columns[1:]]).join(F.broadcast(per))


def _lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("target")).agg(F.count("*").alias("n"))


def alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """177 rows allocated to languages in proportion."""
    return sampling.checked_allocation(_lang_counts(spark, sf_dir), 177)


def merge_pairs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocated documents of each language, the first tenth in hash order for validation."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("target"), "doc_id")
    taken = sampling.take_allocated(docs, sampling.checked_allocation(_lang_counts(spark, sf_dir), 177), "target", SEED, "doc_id")
    return sampling.split(taken, [], 0.1, SEED + 1, "doc_id")


def sft_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality and at most 400 words, a tenth for validation."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", E.word_count("text").alias("n_tokens"))
    return sampling.split(docs.join(good, "doc_id", "left_semi").where("n_tokens <= 400"), [], 0.1, SEED, "doc_id")


def rolling_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of each user."""
    return ranking.newest(_events(spark, sf_dir), ["user_id"], "event_id", 20).select("user_id", "event_id", "age")


def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """137 documents by hash, each with a uniform draw for its temperature."""
    docs = sampling.exact_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 137, SEED, "doc_id")
    return docs.select("doc_id", "lang", r6(E.uniform(SEED + 2, "doc_id") * 0.6 + 0.6, "temperature"))


def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three losses of each pair, its margin scaled by the deviation of all margins."""
    pairs = _pairs(spark, sf_dir)
    logp = lambda side, k: -(F.col(f"{side}_doc_id") % k)
    adv = E.advantage(logp("chosen", 7), logp("rejected", 5), logp("chosen", 3), logp("rejected", 4)) / 10.0
    rows = pairs.select("lang", "chosen_doc_id", "rejected_doc_id", adv.alias("adv"), (F.col("chosen_reward") - F.col("rejected_reward")).alias("raw"))
    scale = rows.agg(stats.clamped_std("raw").alias("std"))
    rows = rows.join(F.broadcast(scale)).withColumn("margin", F.col("raw") / F.col("std"))
    loss = lambda kind, **kw: E.preference_loss(F.col("adv"), F.col("margin"), kind, 2.5, **kw)
    return rows.select("chosen_doc_id", "rejected_doc_id", r6("adv"), r6("margin"), r6(loss("dpo"), "dpo"), r6(loss("cdpo", smooth=0.1), "cdpo"), r6(loss("simpo", gamma=0.5), "simpo"), (F.col("adv") > 0).cast("int").alias("accurate"))


def structure_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as structures by formula, group and cell: type and brand, and lengths and angles from their size."""
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size")
    lattice = [size / 3.0, size / 7.0, size / 11.0, 90.0 + size / 9.0, F.lit(90.0), F.lit(120.0)]
    key = E.structure_key("p_type", "p_brand", lattice)
    return parts.groupBy(key.alias("struct_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"))


def source_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as three sources under one tag each, with a density from a table of targets or its default."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tags = {"lang = 'en'": "NaCl", "lang = 'fr'": "TiO2", "lang is null or lang not in ('en', 'fr')": "other"}
    parts = [docs.where(where).withColumn("source_target", F.lit(tag)) for where, tag in tags.items()]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("ref_density", reward.reference_density(F.col("source_target")))


def routed_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the folder that a routing sink gives them."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    route = F.when(F.col("quality") == 1, "valid").when(F.col("quality") == 0, "invalid").otherwise("unlabelled")
    return docs.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


QUERIES = {f.__name__: f for f in (
    percentile_rank_clip, percentile_rank_buffer, novelty_window, composite_reward, reward_summary, top_bottom_pools, preference_pairs, pair_quality, alloc_largest_remainder, merge_pairs_split, sft_select,
    rolling_trim, exact_sample, preference_losses, structure_key, source_union_tagged, routed_output_counts,
)}

POOLS = """
        ranked as (
          select doc_id, lang, n_chars::double as reward, row_number() over (partition by lang order by n_chars desc, doc_id) as rn, count(*) over (partition by lang) as n from documents),
        pools as (select *, rn <= greatest(1, floor(n * 0.1)) as in_top, rn > n - greatest(1, floor(n * 0.1)) as in_bottom from ranked)"""
PAIRS = f"""{POOLS},
        tops as (select *, row_number() over (partition by lang order by reward desc, doc_id) as p, count(*) over (partition by lang) as nt from pools where in_top),
        bottoms as (select *, row_number() over (partition by lang order by reward desc, doc_id) as p, count(*) over (partition by lang) as nb from pools where in_bottom),
        qualified as (
          select t.lang, t.doc_id as chosen_doc_id, b.doc_id as rejected_doc_id, t.reward as chosen_reward, b.reward as rejected_reward,
                 row_number() over (partition by t.lang order by t.p, b.p) - 1 as number, count(*) over (partition by t.lang) as q
          from tops t join bottoms b on b.lang = t.lang and t.reward - b.reward >= 1000),
        draws as (
          select distinct lang, case when q <= 6000 then i else ('0x' || substr(md5('42|' || lang || '|' || i), 1, 15))::bigint % q end as number
          from (select distinct lang, q from qualified), unnest(range(least(q, 6000)::bigint)) as x(i)),
        crossed as (select * exclude (number, q) from qualified join draws using (lang, number) where chosen_doc_id <> rejected_doc_id),
        pairs as (
          select * from crossed qualify row_number() over (partition by lang order by md5('42|' || chosen_doc_id || '|' || rejected_doc_id), chosen_doc_id, rejected_doc_id) <= 300)"""
ALLOC = """
        counts as (select lang as target, count(*) as n from documents group by lang),
        raw as (select *, 177 * n / sum(n) over () as raw from counts),
        ordered as (select *, row_number() over (order by raw - floor(raw) desc, target) as rank, 177 - sum(floor(raw)) over () as rest from raw),
        alloc as (select target, n, (floor(raw) + case when rank <= rest then 1 else 0 end)::bigint as alloc from ordered)"""
STRUCTURES = """
        s as (
          select p_type as target, p_partkey as seq, p_retailprice as e, p_size / 20.0::double as d, p_retailprice / 400.0::double as density, (p_partkey % 14) as mean_cn, (p_partkey % 19) as max_cn,
                 p_size % 5 = 0 as same, (p_partkey % 100) / 100.0::double as cosine, list_distinct(string_split(p_type, '')) as te, list_distinct(string_split(p_brand, '')) as el, p_brand || '|' || p_size as k
          from part),
        r as (select *, percent_rank() over (partition by target order by e) as pr, d < 0.5 as gated from s),
        passed as (select *, row_number() over (partition by target order by seq) as pos from r where not gated),
        dup as (select *, case when pos - lag(pos) over (partition by target, k order by seq) <= 50 then 1 else 0 end as dup from passed),
        parts as (
          select seq, target, dup, 1 - least(0.95, greatest(0.05, pr)) as r_proxy,
                 (least(1, greatest(0, (d - 0.5) / 0.8)) + least(1, greatest(0, 1 - abs(ln(greatest(density, 1e-8) / 3.5)) / 1.5)) + case when mean_cn < 1 or mean_cn > 12 or max_cn > 16 then 0 else 1 end) / 3 as r_geom,
                 case when same then 1.0 else least(1, greatest(0, cosine - (0.35 * len(list_filter(te, lambda x: not list_contains(el, x))) / len(te) + 0.25 * len(list_filter(el, lambda x: not list_contains(te, x))) / len(el)))) end as r_comp,
                 1.0 - dup as r_novel
          from dup),
        totals as (select *, least(1, greatest(0, 0.7 * r_proxy + 0.1 * r_geom + 0.1 * r_comp + 0.1 * r_novel)) as r_total from parts)"""

ORACLE_SQL = {
    "percentile_rank_clip": """
        select event_id, round(pr, 6) as pr, round(1 - least(0.95, greatest(0.05, pr)), 6) as r_proxy
        from (select event_id, percent_rank() over (partition by event_type order by value) as pr from events)""",
    "percentile_rank_buffer": """
        with b as (select event_type, value from events where ts < '2024-01-10'),
        n as (select event_type, count(*) as n from b group by event_type),
        u as (
          select e.event_id, e.event_type, e.value, 0 as is_buffer from events e where ts >= '2024-01-10'
          union all select null, event_type, value, 1 from b),
        c as (select *, sum(is_buffer) over (partition by event_type order by value) - sum(is_buffer) over (partition by event_type, value) as below from u)
        select event_id, round(case when n = 1 then 0.5 else below / (n - 1) end, 6) as pr from c join n using (event_type) where is_buffer = 0""",
    "novelty_window": """
        with s as (select event_id, event_type || '|' || user_id as k, row_number() over (order by event_id) as pos from events)
        select event_id, (case when pos - lag(pos) over (partition by k order by pos) <= 200 then 1 else 0 end)::int as duplicate_flag from s""",
    "composite_reward": f"""
        with {STRUCTURES}
        select r.seq, r.target, r.gated::int as gate_failed, case when r.gated then 'min_distance_below_threshold' end as gate_reason, t.dup::int as duplicate_flag,
               round(r_proxy::double, 6) as r_proxy, round(r_geom::double, 6) as r_geom, round(r_comp::double, 6) as r_comp, round(r_novel::double, 6) as r_novel,
               round(coalesce(r_total, -1)::double, 6) as r_total
        from r left join totals t using (seq)""",
    "reward_summary": f"""
        with {STRUCTURES}
        select (select count(*) from r) as n_structures, count(*) as n_gate_passed, round((select count(*) filter (gated) / count(*) from r), 6) as gate_failure_rate,
               round(sum(dup) / count(*), 6) as duplicate_rate, round(avg(r_total)::double, 6) as total_mean, round(stddev_pop(r_total)::double, 6) as total_std,
               round(quantile_cont(r_total::double, 0.05), 6) as total_p05, round(quantile_cont(r_total::double, 0.5), 6) as total_p50, round(quantile_cont(r_total::double, 0.95), 6) as total_p95
        from totals""",
    "top_bottom_pools": f"with {POOLS} select doc_id, lang, in_top, in_bottom from pools where in_top or in_bottom",
    "preference_pairs": f"with {PAIRS} select * from pairs",
    "pair_quality": f"""
        with {PAIRS}, g as (select lang, chosen_reward - rejected_reward as gap from pairs), per as (select count(*) as c from g group by lang),
        a as (
          select count(*) as n, round(avg(gap), 6) as gap_mean, round(median(gap), 6) as gap_median, round(stddev_pop(gap), 6) as gap_std, min(gap) as gap_min, max(gap) as gap_max,
                 round(quantile_cont(gap, 0.1), 6) as gap_p10, round(quantile_cont(gap, 0.25), 6) as gap_p25, round(quantile_cont(gap, 0.75), 6) as gap_p75, round(quantile_cont(gap, 0.9), 6) as gap_p90 from g)
        select a.*, p.* from a, (select count(*) as groups, round(avg(c), 6) as mean_pairs, min(c) as least, max(c) as most, round(stddev_pop(c), 6) as std_pairs from per) p""",
    "alloc_largest_remainder": f"with {ALLOC} select target, n, alloc from alloc",
    "merge_pairs_split": f"""
        with {ALLOC}, taken as (
          select target, doc_id from (select lang as target, doc_id, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as rn from documents) join alloc using (target) where rn <= alloc)
        select target, doc_id, row_number() over (order by md5('43|' || doc_id), doc_id) <= floor(count(*) over () * 0.1) as is_val from taken""",
    "sft_select": """
        with d as (
          select doc_id, source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n_tokens
          from documents where doc_id in (select doc_id from labels where quality = 1)),
        k as (select * from d where n_tokens <= 400)
        select *, row_number() over (order by md5('42|' || doc_id), doc_id) <= floor(count(*) over () * 0.1) as is_val from k""",
    "rolling_trim": "select user_id, event_id, (row_number() over w)::int as age from events window w as (partition by user_id order by event_id desc) qualify row_number() over w <= 20",
    "exact_sample": """
        select doc_id, lang, round(('0x' || substr(md5('44|' || doc_id), 1, 8))::bigint / 4294967296.0::double * 0.6 + 0.6, 6) as temperature
        from documents order by md5('42|' || doc_id), doc_id limit 137""",
    "preference_losses": f"""
        with {PAIRS}, x as (
          select chosen_doc_id, rejected_doc_id, ((-(chosen_doc_id % 7)) - (-(rejected_doc_id % 5)) - ((-(chosen_doc_id % 3)) - (-(rejected_doc_id % 4)))) / 10 as adv, chosen_reward - rejected_reward as raw from pairs),
        m as (select *, raw / greatest((select stddev_samp(raw) from x), 1e-8) as margin from x),
        l as (select *, adv * 2.5 + margin as z from m)
        select chosen_doc_id, rejected_doc_id, round(adv, 6) as adv, round(margin, 6) as margin, round(ln(1 + exp(-z)), 6) as dpo,
               round(0.9 * ln(1 + exp(-z)) + 0.1 * ln(1 + exp(z)), 6) as cdpo, round(ln(1 + exp(-(z - 0.5))), 6) as simpo, (adv > 0)::int as accurate
        from l""",
    "structure_key": """
        select p_type || '|' || p_brand || '|(' || round(p_size / 3.0::double, 2) || ', ' || round(p_size / 7.0::double, 2) || ', ' || round(p_size / 11.0::double, 2) || ', ' || round(90.0::double + p_size / 9.0::double, 1) || ', 90.0, 120.0)' as struct_key,
               count(*) as n, min(p_partkey) as first_seen from part group by all""",
    "source_union_tagged": """
        select doc_id, lang, case lang when 'en' then 'NaCl' when 'fr' then 'TiO2' else 'other' end as source_target, case lang when 'en' then 2.16::double when 'fr' then 4.25::double else 3.5::double end as ref_density
        from documents""",
    "routed_output_counts": """
        select case quality when 1 then 'valid' when 0 then 'invalid' else 'unlabelled' end as route, count(*) as n, min(doc_id) as first_doc
        from documents left join labels using (doc_id) group by all""",
}
