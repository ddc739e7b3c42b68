"""The composite reward: validity gate, components, weights, summary."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.functions import expressions as E
from tidelode.operators import ranking, stats

#: Densities of well-known targets, and of any other: fixed values.
KNOWN_DENSITIES = {"LiFePO4": 3.5, "NaCl": 2.16, "TiO2": 4.25, "BaTiO3": 6.02}
DEFAULT_DENSITY = 3.5


@dataclass(frozen=True)
class Weights:
    """Weights of the four components; they are used as shares of their sum."""

    proxy: float = 0.7
    geom: float = 0.1
    comp: float = 0.1
    novel: float = 0.1

    def normalised(self) -> Weights:
        total = self.proxy + self.geom + self.comp + self.novel
        if total <= 0:
            raise ValueError("the sum of reward weights must be positive")
        if abs(total - 1) > 0.001:
            logging.getLogger(__name__).warning("reward weights sum to %.4f and are normalised", total)
        return Weights(self.proxy / total, self.geom / total, self.comp / total, self.novel / total)

    def shares(self) -> list[float]:
        w = self.normalised()
        return [w.proxy, w.geom, w.comp, w.novel]


def reference_density(target: Column) -> Column:
    """The density of a target by the table, or the default."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN_DENSITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, target), F.lit(DEFAULT_DENSITY))


def gate_reason(distance: Column, density: Column, least_distance: float, parsed: Column | None = None, density_gate: bool = False, density_range: tuple[float, float] = (0.5, 25.0)) -> Column:
    """The first reason that gates a structure, null if none does."""
    reason = F.when(~parsed, "parse_or_structure_fail") if parsed is not None else F.when(F.lit(False), "")
    reason = reason.when(~E.finite(distance), "min_distance_nan").when(distance < least_distance, "min_distance_below_threshold")
    if density_gate:
        reason = reason.when(~E.finite(density) | (density < density_range[0]) | (density > density_range[1]), "density_out_of_range")
    return reason.otherwise(F.lit(None).cast("string"))


def composite(rows: DataFrame, weights: Weights, least_distance: float = 0.5, window: int = 2000, history: DataFrame | None = None, buffer: DataFrame | None = None, target: str = "target", order: str = "seq") -> DataFrame:
    """Rows with their reward components and total; gated rows have r_total -1 and no components.

    rows: target, seq, e_per_atom (finite), min_distance, density, ref_density, mean_cn, max_cn, same,
    cosine, target_elements, elements, struct_key. buffer holds target and e_per_atom of earlier batches,
    history target, struct_key and hseq. Percentiles rank all rows, gated or not; novelty counts rows that
    pass the gate only.
    """
    if buffer is None:
        ranked = ranking.percentile_rank(rows, [target], "e_per_atom", "percentile")
    else:
        first = ranking.percentile_rank(rows, [target], "e_per_atom", "__own")
        ranked = ranking.percentile_rank_in(first, buffer, [target], "e_per_atom", "percentile").withColumn("percentile", F.coalesce("percentile", "__own")).drop("__own")
    gated = ranked.withColumn("gate_reason", gate_reason(F.col("min_distance"), F.col("density"), least_distance))
    passed = ranking.duplicate_in_window(gated.where("gate_reason is null"), [target], "struct_key", [order], window, history)
    failed = gated.where("gate_reason is not null").withColumn("duplicate_flag", F.lit(None).cast("int"))
    both = passed.unionByName(failed)
    ok = F.col("gate_reason").isNull()
    parts = {
        "r_proxy": E.r_proxy(F.col("percentile")),
        "r_geom": E.r_geom(F.col("min_distance"), least_distance, F.col("density"), F.col("ref_density"), F.col("mean_cn"), F.col("max_cn")),
        "r_comp": E.r_comp(F.col("same"), F.col("cosine"), F.col("target_elements"), F.col("elements")),
        "r_novel": 1.0 - F.col("duplicate_flag"),
    }
    both = both.withColumns({k: F.when(ok, v) for k, v in parts.items()})
    total = F.when(ok, E.r_total([F.col(k) for k in parts], weights.shares())).otherwise(-1.0)
    return both.withColumns({"r_total": total, "gate_failed": (~ok).cast("int")})


def summary(rewards: DataFrame) -> DataFrame:
    """One row: counts and rates over all rows, statistics of components over rows that passed."""
    ok = F.col("gate_failed") == 0
    n = F.count("*")
    counts = rewards.agg(n.alias("n_structures"), F.count_if(ok).alias("n_gate_passed"), stats.rate(F.count_if(~ok), n).alias("gate_failure_rate"), stats.rate(F.sum(F.coalesce("duplicate_flag", F.lit(0))), F.count_if(ok)).alias("duplicate_rate"))
    names = ("r_proxy", "r_geom", "r_comp", "r_novel", "r_total")
    parts = stats.component_stats(stats.stacked(rewards.where(ok), names), ["name"], "value")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("mean", "std", "p05", "p50", "p95")])
    wide = parts.agg(*[F.coalesce(F.max(F.when(F.col("name") == c, F.struct("mean", "std", "p05", "p50", "p95"))), zero).alias(c) for c in names])
    return counts.join(F.broadcast(wide))
