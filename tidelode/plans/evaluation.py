"""Queries of evaluation: scores joined to labels, rates, summaries, distributions, roll-ups.

The tables stand in for those of the workflow: unit prices of lines for energies, part types for formulas,
documents and labels for structures and their validity, languages for targets, order states for phases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions import expressions as E
from tidelode.operators import gates, joins, ranking, stats
from tidelode.plans.common import props_value, r6, table
from tidelode.scratch import Workspace

EVENT_NUMBER = "try_cast(json_extract_string(props, '$.k') as double)"


def eval_merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the quality label of those that have one."""
    labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.eval_merge(labels, table(spark, sf_dir, "labels"), "doc_id", "quality")


def candidate_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first reason that keeps them from being candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("valid"), (F.col("n_chars") > 100).alias("hit_target"))
    labels = table(spark, sf_dir, "labels")
    rewards = labels.select("doc_id", F.when(F.col("toxic") == 1, -1.0).otherwise(1.0).alias("reward"), (1 - F.col("quality")).alias("gate_failed"))
    scores = labels.where("quality = 1 or toxic = 1").select("doc_id", F.col("quality").alias("score"))
    rows = joins.candidate_reasons(docs, scores, rewards, "doc_id", F.col("valid"), "score", "reward", "gate_failed")
    return joins.reason_counts(rows)


def three_table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with label and reward; -1 where either is missing or the label gates them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    rewards = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("reward"))
    rows = joins.lookup(docs.join(labels, "doc_id", "left"), rewards, "doc_id", "reward", -1.0)
    gated = F.coalesce(F.col("quality") == 0, F.lit(False))
    return rows.select("doc_id", "lang", "quality", "toxic", F.when(gated, -1.0).otherwise(F.col("reward")).alias("r_total"))


def label_hit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and hits of parts against the target type, by brand."""
    parts = table(spark, sf_dir, "part").withColumn("valid", F.col("p_size") > 5)
    parts = parts.withColumn("hit", F.when(F.col("valid"), F.col("p_type") == "ECONOMY").otherwise(False))
    return parts.groupBy("p_brand").agg(*stats.hit_rates(F.col("valid"), F.col("hit"))).select("p_brand", "total", "valid", "hits", r6("validity_rate"), r6("hit_rate"))


def scored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, and those whose properties hold a number."""
    return stats.scored_counts(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")), "k")


def safe_cast_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their properties, bad and non-finite ones left out."""
    rows = table(spark, sf_dir, "events").select("event_id", props_value().alias("k"))
    return rows.where(E.finite("k"))


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the type of their part and their unit price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("e_per_atom"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("formula"))
    return lines.join(parts, "l_partkey")


UNIT_PRICES = """
        prices as (
          select l_orderkey, l_linenumber, l_partkey, p_type as formula, l_extendedprice / l_quantity as e_per_atom
          from lineitem join part on p_partkey = l_partkey)"""
BOTTOM = """
        ranked as (
          select *, row_number() over (partition by formula order by e_per_atom) as rn, count(*) over (partition by formula) as n from prices),
        bottom as (
          select formula, avg(e_per_atom) as fallback from ranked where rn <= greatest(1, floor(n * 0.1)) group by formula)"""


def hull_ref_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type the mean of its lowest tenth of unit prices."""
    return ranking.bottom_mean(unit_prices(spark, sf_dir), ["formula"], "e_per_atom", 0.1).select("formula", r6("fallback"))


def _references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ECONOMY", 900.0), ("PROMO", 950.0)], "formula string, hull_energy double")


def hull_ref_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the way their reference was found, with the mean excess over it."""
    prices = Workspace(spark, "prices").write(unit_prices(spark, sf_dir).select("formula", "e_per_atom"), "prices")
    bottom = ranking.bottom_mean(prices.where("formula <> 'SMALL'"), ["formula"], "e_per_atom", 0.1)
    rows = joins.hull_reference(prices, _references(spark), bottom)
    return rows.groupBy("formula", "ehull_method").agg(F.count("*").alias("n"), r6(F.avg("ehull_proxy"), "mean_excess"))


def stability_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type the lines whose excess over the reference is under a threshold."""
    prices = Workspace(spark, "prices").write(unit_prices(spark, sf_dir).select("formula", "e_per_atom"), "prices")
    rows = joins.hull_reference(prices, _references(spark).limit(0), ranking.bottom_mean(prices, ["formula"], "e_per_atom", 0.1))
    stable = F.count_if(F.col("ehull_proxy") < 100.0)
    return rows.groupBy("formula").agg(F.count("*").alias("total"), stable.alias("stable"), r6(stats.rate(stable, F.count("*")), "stability_rate"))


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of event values by type."""
    rows = stats.component_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rows.select("event_type", *[r6(c) for c in ("mean", "std", "p05", "p50", "p95")])


def energy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and deviation of unit prices by type."""
    rows = stats.energy_summary(unit_prices(spark, sf_dir), ["formula"], "e_per_atom")
    return rows.select("formula", r6("mean"), r6("median"), r6("std"))


def nearest_index_p10_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenth and ninetieth by index, best and worst of event values by type."""
    return ranking.nearest_index(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the numeric columns of lines."""
    rows = stats.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.select("name", *[r6(c) for c in ("mean", "median", "std", "min", "max")])


def sft_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source with their share and lengths."""
    docs = table(spark, sf_dir, "documents")
    rows = stats.fractions(docs, "source").join(stats.energy_summary(docs, ["source"], "n_chars"), "source")
    return rows.select("source", "n", r6("fraction"), r6("mean"), r6("median"), r6("std"))


def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten cheapest lines of each type with their rank."""
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    return ranking.top_n(unit_prices(spark, sf_dir), ["formula"], ["e_per_atom", *tie], 10).select("formula", "rank", *tie, r6("e_per_atom"))


def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest brands, the one met first on ties."""
    return stats.most_common(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 10)


def diversity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (type, brand) over parts."""
    return stats.diversity(table(spark, sf_dir, "part"), ["p_type", "p_brand"]).select("n", "distinct_keys", r6("diversity_ratio"))


def distribution_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and their share."""
    return stats.fractions(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", r6("fraction"))


def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty equal bins of event values, empty ones too, with their densities."""
    return stats.histogram(table(spark, sf_dir, "events"), "value", 80, density=True).select("bin", r6("left_edge"), "n", r6("density"))


def histogram_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty-nine bins between the first and the last percentile."""
    return stats.histogram(table(spark, sf_dir, "events"), "value", 59, (0.01, 0.99)).select("bin", r6("left_edge"), "n")


def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's point of the empirical distribution of its type."""
    rows = ranking.ecdf(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", ["event_id"])
    return rows.select("event_id", "event_type", r6("cdf"))


def three_way_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each priority the order value of three phases, their changes against the first, and a verdict."""
    phases = {"F": "baseline", "O": "sft", "P": "dpo"}
    orders = table(spark, sf_dir, "orders").withColumn("phase", F.element_at(F.create_map(*[F.lit(x) for p in phases.items() for x in p]), F.col("o_orderstatus")))
    each = orders.groupBy("o_orderpriority", "phase").agg(F.count("*").alias("n"), stats.rate(F.count_if(F.col("o_totalprice") > 150000), F.count("*")).alias("stability"), F.avg("o_totalprice").alias("mean"))
    wide = joins.by_phase(each, ["o_orderpriority"], "phase", list(phases.values()), {"stability": F.col("stability"), "energy_mean": F.col("mean")})
    gain = F.round(F.col("dpo_stability") - F.col("baseline_stability"), 6)
    return wide.select("o_orderpriority", *[r6(f"{p}_{m}") for m in ("stability", "energy_mean") for p in phases.values()], gain.alias("delta_dpo"), r6(F.col("sft_stability") - F.col("baseline_stability"), "delta_sft"), E.verdict(gain).alias("verdict"))


def cross_branch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each market segment in three phases."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    each = orders.join(customers, "o_custkey").groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return joins.by_phase(each, ["c_mktsegment"], "o_orderstatus", ["F", "O", "P"], {"orders": F.col("n")})


def timing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from the first to the last event of each type, by a log of starts and ends."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_type", seconds.alias("timestamp"), "event_id")
    log = events.groupBy("event_type").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    log = log.select(F.col("event_type").alias("phase"), F.explode(F.array(F.struct(F.lit("start").alias("status"), F.col("a").alias("timestamp"), F.lit(1).alias("seq")), F.struct(F.lit("end").alias("status"), F.col("b").alias("timestamp"), F.lit(2).alias("seq")))).alias("x")).select("phase", "x.*")
    return stats.timing_rollup(log)


def retry_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each user on days without a purchase of theirs, with the first of them."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    errors, done = events.where("event_type = 'error'"), events.where("event_type = 'purchase'")
    return errors.join(done, ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("errors"), F.min("event_id").alias("first_error"))


def training_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each hundred steps of the event log, with the learning rate at their end."""
    rows = stats.count_windows(table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), "value"), "step", 100, ["value"])
    rate = E.cosine_lr(F.col("window") * 100, 20000, 5e-6, 500)
    return rows.select("window", "n", r6("mean_value"), r6(rate * 1e6, "lr_micro"))


def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest value of each event type and the first step that has it."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*stats.best_step("value", "event_id"))


def latency_split_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of all events and of successes by user, and the mean weighted by the event number."""
    rows = table(spark, sf_dir, "events").withColumn("w", F.col("event_id").cast("double")).groupBy("user_id").agg(*stats.latency_split("value", F.col("event_type") != "error"), stats.weighted_mean("value", "w").alias("weighted"))
    return rows.select("user_id", r6("mean_all"), r6("mean_success"), r6("weighted"))


def merge_count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand counts of small and of large parts, added up."""
    parts = table(spark, sf_dir, "part")
    count = lambda where: parts.where(where).groupBy("p_brand").agg(F.count("*").alias("n"))
    return stats.merge_counts(count("p_size <= 25"), count("p_size > 25"), "p_brand")


def min_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line of each part and the latest ship date of it."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_partkey").agg(r6(F.min(F.col("l_extendedprice") / F.col("l_quantity")), "min_energy"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("last_shipped"))


def fail_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events of each user and whether their share passes."""
    events = table(spark, sf_dir, "events").withColumn("score", F.when(F.col("event_type") == "error", "").otherwise("1"))
    rows = gates.fail_rates(events, "score", ("user_id",))
    return rows.select("user_id", "total", "failed", r6("fail_rate"), (F.col("fail_rate") <= 0.25).alias("passed"))


def reward_spread_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether event values of each type spread enough."""
    std = F.stddev_pop("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r6(std, "std"), F.coalesce(std >= 0.05, F.lit(False)).alias("passed"))


def pair_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents there against a number asked for."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return gates.availability(counts, 5000)


QUERIES = {f.__name__: f for f in (
    eval_merge_left, candidate_drop_reasons, three_table_candidates, label_hit_target, scored_counts, safe_cast_scan, hull_ref_fallback, hull_ref_method, stability_rate, component_stats,
    energy_summary, nearest_index_p10_p90, numeric_profile, sft_source_stats, top_n_per_group, most_common, diversity_ratio, distribution_fraction, histogram_fixed, histogram_clipped, ecdf, three_way_report,
    cross_branch_table, timing_rollup, retry_backlog, training_log_windows, best_step, latency_split_avg, merge_count_maps, min_by_reference, fail_rate_gate, reward_spread_gate, pair_availability,
)}

ORACLE_SQL = {
    "eval_merge_left": "select d.doc_id, d.lang, d.source, l.quality from documents d left join labels l using (doc_id)",
    "candidate_drop_reasons": """
        with rows_ as (
          select case when not (d.lang = 'en' and d.n_chars > 100) then 'invalid_or_mismatch'
                      when l.doc_id is null or not (l.quality = 1 or l.toxic = 1) then 'missing_score'
                      when l.quality = 0 then 'gate_failed'
                      when l.toxic = 1 then 'negative_reward' else 'kept' end as drop_reason
          from documents d left join labels l using (doc_id))
        select drop_reason, count(*) as n from rows_ group by drop_reason""",
    "three_table_candidates": """
        select d.doc_id, d.lang, l.quality, l.toxic, case when l.quality = 0 then -1.0::double else coalesce(e.reward, -1.0::double) end as r_total
        from documents d left join labels l using (doc_id)
        left join (select user_id as doc_id, max(value) as reward from events group by user_id) e using (doc_id)""",
    "label_hit_target": """
        select p_brand, count(*) as total, count(*) filter (p_size > 5) as valid, count(*) filter (p_size > 5 and p_type = 'ECONOMY') as hits,
               round(count(*) filter (p_size > 5) / count(*), 6) as validity_rate,
               round(count(*) filter (p_size > 5 and p_type = 'ECONOMY') / count(*), 6) as hit_rate
        from part group by p_brand""",
    "scored_counts": "select count(*) as n_rows, count(*) filter (trim(coalesce(json_extract_string(props, '$.k'), '')) <> '') as n_scored from events",
    "safe_cast_scan": f"select event_id, {EVENT_NUMBER} as k from events where isfinite({EVENT_NUMBER})",
    "hull_ref_fallback": f"with {UNIT_PRICES}, {BOTTOM} select formula, round(fallback, 6) as fallback from bottom",
    "hull_ref_method": f"""
        with {UNIT_PRICES}, {BOTTOM},
        known as (select * from (values ('ECONOMY', 900.0::double), ('PROMO', 950.0::double)) as t(formula, hull_energy))
        select p.formula, case when hull_energy is not null then 'mp_api' when b.fallback is not null then 'fallback_percentile' else 'self' end as ehull_method,
               count(*) as n, round(avg(e_per_atom - coalesce(hull_energy, b.fallback, e_per_atom)), 6) as mean_excess
        from prices p left join known using (formula) left join (select * from bottom where formula <> 'SMALL') b using (formula)
        group by all""",
    "stability_rate": f"""
        with {UNIT_PRICES}, {BOTTOM}
        select formula, count(*) as total, count(*) filter (e_per_atom - fallback < 100.0) as stable,
               round(count(*) filter (e_per_atom - fallback < 100.0) / count(*), 6) as stability_rate
        from prices join bottom using (formula) group by formula""",
    "component_stats": """
        select event_type, round(coalesce(avg(value), 0), 6) as mean, round(coalesce(stddev_pop(value), 0), 6) as std,
               round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95
        from events where isfinite(value) group by event_type""",
    "energy_summary": f"""
        with {UNIT_PRICES}
        select formula, round(avg(e_per_atom), 6) as mean, round(median(e_per_atom), 6) as median, round(coalesce(stddev_samp(e_per_atom), 0), 6) as std
        from prices group by formula""",
    "nearest_index_p10_p90": """
        with ranked as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events)
        select event_type, case when max(n) > 10 then max(value) filter (rn = floor(n * 0.1) + 1) else min(value) end as p10,
               case when max(n) > 10 then max(value) filter (rn = floor(n * 0.9) + 1) else max(value) end as p90, min(value) as best, max(value) as worst
        from ranked group by event_type""",
    # the mean by whole hundredths, half up: means of these columns can end in a 5 at the seventh place
    "numeric_profile": " union all ".join(
        f"select '{c}' as name, ((2 * sum(round({c} * 100)::hugeint) * 10000 + count({c})) // (2 * count({c}))) / 1000000.0 as mean, round(median({c}), 6) as median, round(stddev_pop({c}), 6) as std, round(min({c}), 6) as min, round(max({c}), 6) as max from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "sft_source_stats": """
        select source, count(*) as n, round(count(*) / (select count(*) from documents), 6) as fraction, round(avg(n_chars), 6) as mean,
               round(median(n_chars), 6) as median, round(coalesce(stddev_samp(n_chars), 0), 6) as std
        from documents group by source""",
    "top_n_per_group": f"""
        with {UNIT_PRICES}
        select formula, row_number() over w::int as rank, l_orderkey, l_linenumber, l_partkey, round(e_per_atom, 6) as e_per_atom
        from prices window w as (partition by formula order by e_per_atom, l_orderkey, l_linenumber, l_partkey) qualify row_number() over w <= 10""",
    "most_common": "select p_brand, count(*) as n, min(p_partkey) as first_seen from part group by p_brand order by n desc, first_seen limit 10",
    "diversity_ratio": "select count(*) as n, count(distinct (p_type, p_brand)) as distinct_keys, round(count(distinct (p_type, p_brand)) / count(*), 6) as diversity_ratio from part",
    "distribution_fraction": "select event_type, count(*) as n, round(count(*) / (select count(*) from events), 6) as fraction from events group by event_type",
    "histogram_fixed": """
        with r as (select min(value) as lo, max(value) as hi from events),
        c as (select least(floor((value - lo) * 80 / (hi - lo)), 79)::int as bin, count(*) as n from events, r group by all)
        select b::int as bin, round(lo + (hi - lo) * b / 80, 6) as left_edge, coalesce(n, 0) as n, round(coalesce(n, 0) / ((select sum(n) from c) * (hi - lo) / 80), 6) as density
        from r, unnest(range(80)) as t(b) left join c on c.bin = b""",
    "histogram_clipped": """
        with r as (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events),
        c as (select least(floor((value - lo) * 59 / (hi - lo)), 58)::int as bin, count(*) as n from events, r where value between lo and hi group by all)
        select b::int as bin, round(lo + (hi - lo) * b / 59, 6) as left_edge, coalesce(n, 0) as n
        from r, unnest(range(59)) as t(b) left join c on c.bin = b""",
    "ecdf": "select event_id, event_type, round(row_number() over (partition by event_type order by value, event_id) / count(*) over (partition by event_type), 6) as cdf from events",
    "three_way_report": """
        with each as (
          select o_orderpriority, o_orderstatus as s, count(*) filter (o_totalprice > 150000) / count(*) as stability, avg(o_totalprice) as mean from orders group by all),
        wide as (
          select o_orderpriority, max(stability) filter (s = 'F') as b, max(stability) filter (s = 'O') as t, max(stability) filter (s = 'P') as d,
                 max(mean) filter (s = 'F') as bm, max(mean) filter (s = 'O') as tm, max(mean) filter (s = 'P') as dm
          from each group by o_orderpriority)
        select o_orderpriority, round(b, 6) as baseline_stability, round(t, 6) as sft_stability, round(d, 6) as dpo_stability,
               round(bm, 6) as baseline_energy_mean, round(tm, 6) as sft_energy_mean, round(dm, 6) as dpo_energy_mean,
               round(d - b, 6) as delta_dpo, round(t - b, 6) as delta_sft,
               case when round(d - b, 6) > 0.02 then 'meaningful' when round(d - b, 6) > 0 then 'marginal' else 'none' end as verdict
        from wide""",
    "cross_branch_table": """
        select c_mktsegment, count(*) filter (o_orderstatus = 'F') as F_orders, count(*) filter (o_orderstatus = 'O') as O_orders, count(*) filter (o_orderstatus = 'P') as P_orders
        from orders join customer on c_custkey = o_custkey group by c_mktsegment""",
    "timing_rollup": "select event_type as phase, floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint as seconds from events group by event_type",
    "retry_backlog": """
        select user_id, count(*) as errors, min(event_id) as first_error from events
        where event_type = 'error' and (user_id, ts::date) not in (select (user_id, ts::date) from events where event_type = 'purchase') group by user_id""",
    "training_log_windows": """
        select w as window, n, round(mean, 6) as mean_value,
               round(case when w * 100 < 500 then 5e-6 * (w * 100) / 500 else 5e-6 * 0.5 * (1 + cos(pi() * (w * 100 - 500) / 19500)) end * 1e6, 6) as lr_micro
        from (select ceil((event_id + 1) / 100)::bigint as w, count(*) as n, avg(value) as mean from events group by all)""",
    "best_step": "select event_type, min(value) as best_value, arg_min(event_id, (value, event_id)) as best_step from events group by event_type",
    "latency_split_avg": """
        select user_id, round(avg(value), 6) as mean_all, round(coalesce(avg(value) filter (event_type <> 'error'), 0), 6) as mean_success,
               round(sum(value * event_id) / sum(event_id), 6) as weighted
        from events group by user_id""",
    "merge_count_maps": "select p_brand, count(*) as n from part group by p_brand",
    "min_by_reference": "select l_partkey, round(min(l_extendedprice / l_quantity), 6) as min_energy, max(strftime(l_shipdate, '%Y-%m-%d')) as last_shipped from lineitem group by l_partkey",
    "fail_rate_gate": """
        select user_id, count(*) as total, count(*) filter (event_type = 'error') as failed, round(count(*) filter (event_type = 'error') / count(*), 6) as fail_rate,
               count(*) filter (event_type = 'error') / count(*) <= 0.25 as passed
        from events group by user_id""",
    "reward_spread_gate": "select event_type, round(stddev_pop(value), 6) as std, stddev_pop(value) >= 0.05 as passed from events group by event_type",
    "pair_availability": "select count(*) as available, 5000::bigint as required, greatest(5000 - count(*), 0)::bigint as shortfall, count(*) >= 5000 as enough from documents",
}
