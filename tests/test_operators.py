"""Edge rows of joins, ranks, samples, gates and formulas, with values worked out by hand or from published reports."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelode import scratch
from tidelode.functions import expressions as E
from tidelode.functions.low_rank import merged_weights
from tidelode.operators import crystal, gates, joins, neighbours, ranking, reward, sampling, stats


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()[0]


@pytest.mark.parametrize(("text", "value"), [("", None), (" 1.5 ", 1.5), ("abc", None), ("inf", math.inf), ("1_000", None), ("1.0d", None), ("-2e3", -2000.0), (None, None)])
def test_safe_double(spark, text, value):
    assert one(spark, E.safe_double(F.lit(text).cast("string"))) == value


def test_safe_double_nan(spark):
    assert math.isnan(one(spark, E.safe_double(F.lit("nan"))))


@pytest.mark.parametrize(("text", "value"), [("True", True), ("true", False), ("", False), (None, False)])
def test_is_true(spark, text, value):
    assert one(spark, E.is_true(F.lit(text).cast("string"))) is value


def test_clip(spark):
    assert one(spark, E.clip(F.lit(float("nan")), 0.0, 1.0)) == 1.0
    assert one(spark, E.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None


@pytest.mark.parametrize(("text", "out"), [("data_X", ""), ("\ndata_X\na", "\ndata_X\na"), ("a\nb", "a\nb"), ("data_X\na\nb", "a\nb")])
def test_strip_data_header(spark, text, out):
    assert one(spark, E.strip_data_header(F.lit(text))) == out


@pytest.mark.parametrize(("text", "out"), [("x\ndata_a\n1\ndata_b\n2", "data_a\n1"), ("none\nhere", "none\nhere"), ("DATA_a\n1", "DATA_a\n1")])
def test_first_data_block(spark, text, out):
    assert one(spark, E.first_data_block(F.lit(text))) == out


@pytest.mark.parametrize(("formula", "z", "out"), [("LiFePO4", 4, "data_Li4Fe4P4O16"), ("TiO2", 1, "data_TiO2"), ("NaCl", 4, "data_Na4Cl4")])
def test_build_prompt(spark, formula, z, out):
    assert one(spark, E.build_prompt(F.lit(formula), z)) == out


def test_reduced_formula(spark):
    assert one(spark, E.reduced(F.lit("Li4Fe4P4O16"))) == {"Li": 1, "Fe": 1, "P": 1, "O": 4}
    assert one(spark, E.reduced(F.lit("Na2"))) == {"Na": 1}


@pytest.mark.parametrize(("parts", "total"), [((0.5034, 0.6671, 0.9890, 0.9950), 0.6175), ((0.5891, 0.6305, 0.9929, 0.6473), 0.6395), ((0.5034, 0.6881, 0.9728, 0.8509), 0.6036)])
def test_published_totals(spark, parts, total):
    assert one(spark, E.r_total([F.lit(p) for p in parts], reward.Weights().shares())) == pytest.approx(total, abs=1.01e-4)


def test_losses_are_stable(spark):
    for adv in (-800.0, 800.0):
        assert math.isfinite(one(spark, E.preference_loss(F.lit(adv), F.lit(0.0), "dpo", 1.0)))
    with pytest.raises(ValueError):
        E.preference_loss(F.lit(0.0), F.lit(0.0), "other", 1.0)


def test_verdicts(spark):
    assert [one(spark, E.verdict(F.lit(g))) for g in (0.03, 0.002, -0.0175)] == ["meaningful", "marginal", "none"]


def test_weights():
    assert sum(reward.Weights(2, 0, 0, 0).shares()) == 1
    with pytest.raises(ValueError):
        reward.Weights(0, 0, 0, 0).normalised()


def test_merge_keeps_labels_and_takes_the_last(spark):
    labels = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "seq int, file string, error string")
    scores = spark.createDataFrame([("a", "1.0"), ("z", "2.0"), ("b", " ")], "file string, score_e_per_atom string")
    got = {r.file: (r.error, r.score_e_per_atom) for r in joins.eval_merge(joins.last_wins(labels, ["file"], "seq"), scores).collect()}
    assert got == {"a": ("y", "1.0"), "b": ("z", None)}


def test_reasons_count_once(spark):
    labels = spark.createDataFrame([("a", False, True), ("b", True, True), ("c", True, True), ("d", True, False)], "file string, valid boolean, hit_target boolean")
    scores = spark.createDataFrame([("b", 1.0), ("c", 1.0), ("q", 1.0)], "file string, s double")
    rewards = spark.createDataFrame([("b", 0.5, 0), ("c", -1.0, 1)], "file string, r double, g int")
    rows = joins.candidate_reasons(labels, scores, rewards, "file", F.col("valid"), "s", "r", "g")
    assert {r.file: r.drop_reason for r in rows.collect()} == {"a": "invalid_or_mismatch", "b": None, "c": "gate_failed", "d": "invalid_or_mismatch"}


def numbers(spark, values, key="k"):
    return spark.createDataFrame([(key, float(v), i) for i, v in enumerate(values)], "g string, v double, i long")


def test_percentile_ranks(spark):
    assert {r.pr for r in ranking.percentile_rank(numbers(spark, [3]), ["g"], "v").collect()} == {0.5}
    assert {r.pr for r in ranking.percentile_rank(numbers(spark, [3, 3, 3]), ["g"], "v").collect()} == {0.0}
    rng = np.random.default_rng(1)
    values, buffer = rng.integers(0, 20, 60), rng.integers(0, 20, 41)
    got = ranking.percentile_rank_in(numbers(spark, values), numbers(spark, buffer), ["g"], "v")
    for r in got.collect():
        assert r.pr == pytest.approx((buffer < r.v).sum() / 40)


def with_nulls(spark):
    rows = [("a", 1.0, 0), ("a", 3.0, 1), ("a", None, 2), (None, 2.0, 3), (None, 5.0, 4), (None, 2.0, 5), ("b", float("nan"), 6), ("b", 1.0, 7)]
    return spark.createDataFrame(rows, "g string, v double, i long")


def test_percentile_ranks_keep_null_rows(spark):
    rows = with_nulls(spark)
    got = {r.i: r.pr for r in ranking.percentile_rank(rows, ["g"], "v").collect()}
    assert got == {0: 0.0, 1: 1.0, 2: None, 3: 0.0, 4: 1.0, 5: 0.0, 6: 1.0, 7: 0.0}
    buffer = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", None), (None, 1.0), (None, 3.0), (None, 4.0)], "g string, v double")
    got = {r.i: r.pr for r in ranking.percentile_rank_in(rows, buffer, ["g"], "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: None, 3: 0.5, 4: 1.5, 5: 0.5, 6: None, 7: None}


def test_allocated_rows_of_a_null_target(spark):
    shares = spark.createDataFrame([("a", 2), (None, 2)], "g string, alloc long")
    got = sampling.take_allocated(with_nulls(spark), shares, "g", 1, "i").collect()
    assert sorted(str(r.g) for r in got) == ["None", "None", "a", "a"]


def test_pairs_of_null_prompts_and_rewards(spark):
    rows = with_nulls(spark).withColumns({"in_top": F.lit(True), "in_bottom": F.lit(True)})
    got = {(r.g, r.chosen_i, r.rejected_i) for r in sampling.preference_pairs(rows.where("not isnan(v) or v is null"), "g", "i", "v", 1.0, 9, 1).collect()}
    assert got == {("a", 1, 0), (None, 4, 3), (None, 4, 5)}


def test_rare_pairs_are_all_found(spark):
    """Of 40,000 pairs only 6 meet the gap; draws of all pairs would miss most."""
    rows = numbers(spark, [*range(100, 300), *range(200)]).withColumns({"in_top": F.col("i") < 200, "in_bottom": F.col("i") >= 200})
    pairs = sampling.preference_pairs(rows, "g", "i", "v", 297.0, 5, 1, tries=2).collect()
    assert len(pairs) == 5 and all(p.chosen_reward - p.rejected_reward >= 297 for p in pairs)
    assert sampling.preference_pairs(rows, "g", "i", "v", 297.0, 50, 1, tries=2).count() == 6


def test_large_sample(spark, monkeypatch):
    small = {r.id for r in sampling.exact_sample(spark.range(500), 40, 1, "id").collect()}
    monkeypatch.setattr(sampling, "TOP_K", 10)
    assert {r.id for r in sampling.exact_sample(spark.range(500), 40, 1, "id").collect()} == small


def test_nearest_index(spark):
    r = ranking.nearest_index(numbers(spark, range(20)), ["g"], "v").head()
    assert (r.p10, r.p90, r.best, r.worst) == (2.0, 18.0, 0.0, 19.0)
    r = ranking.nearest_index(numbers(spark, range(5)), ["g"], "v").head()
    assert (r.p10, r.p90) == (0.0, 4.0)


def test_bottom_mean_of_few(spark):
    assert ranking.bottom_mean(numbers(spark, [5, 1, 2, 3, 4]), ["g"], "v", 0.1).head().fallback == 1.0


@pytest.mark.parametrize(("history", "keys", "width", "flags"), [("", "ABA", 1, "000"), ("", "ABA", 2, "001"), ("A", "A", 2, "1"), ("AB", "CA", 2, "00"), ("AB", "A", 2, "1")])
def test_novelty(spark, history, keys, width, flags):
    rows = spark.createDataFrame([("t", k, i) for i, k in enumerate(keys)], "t string, k string, seq long")
    old = spark.createDataFrame([("t", k, i) for i, k in enumerate(history)], "t string, k string, hseq long")
    got = ranking.duplicate_in_window(rows, ["t"], "k", ["seq"], width, old).orderBy("seq").collect()
    assert "".join(str(r.duplicate_flag) for r in got) == flags


def test_novelty_like_a_loop(spark):
    rng = np.random.default_rng(3)
    keys = [str(x) for x in rng.integers(0, 15, 300)]
    rows = spark.createDataFrame([("t", k, i) for i, k in enumerate(keys)], "t string, k string, seq long")
    got = [r.duplicate_flag for r in ranking.duplicate_in_window(rows, ["t"], "k", ["seq"], 10).orderBy("seq").collect()]
    assert got == [int(k in keys[max(0, i - 10) : i]) for i, k in enumerate(keys)]


def test_pools(spark):
    rows = ranking.pools(numbers(spark, [1, 2]), ["g"], "v", ["i"], 0.3, 0.3).collect()
    assert sorted((r.v, r.in_top, r.in_bottom) for r in rows) == [(1.0, False, True), (2.0, True, False)]
    rows = ranking.pools(numbers(spark, [1, 2, 3]), ["g"], "v", ["i"], 0.3, 0.3, "all")
    assert sampling.preference_pairs(rows, "g", "i", "v", -9.0, 99, 1).where("chosen_i = rejected_i").count() == 0


def test_gap_is_inclusive(spark):
    rows = numbers(spark, [0.0, 0.5]).withColumns({"in_top": F.lit(True), "in_bottom": F.lit(True)})
    assert sampling.preference_pairs(rows, "g", "i", "v", 0.5, 9, 1).count() == 1


def test_draws_of_large_pools(spark):
    rows = numbers(spark, range(200)).withColumns({"in_top": F.col("v") >= 100, "in_bottom": F.col("v") < 100})
    pairs = sampling.preference_pairs(rows, "g", "i", "v", 50.0, 30, 1).collect()
    assert len(pairs) == len({(p.chosen_i, p.rejected_i) for p in pairs}) == 30
    assert all(p.chosen_reward - p.rejected_reward >= 50 for p in pairs)


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "target string, n long")
    assert {r.target: r.alloc for r in sampling.checked_allocation(counts, 2).collect()} == {"a": 1, "b": 1, "c": 0}
    for total, rows, code in ((5, counts, 2), (1, counts.limit(0), 1)):
        with pytest.raises(sampling.AllocationError) as e:
            sampling.checked_allocation(rows, total)
        assert e.value.code == code


def test_split_of_few(spark):
    assert sampling.split(spark.range(9), [], 0.1, 1, "id").where("is_val").count() == 0
    assert sampling.split(spark.range(30), [], 0.1, 1, "id").where("is_val").count() == 3


def test_timings(spark):
    log = spark.createDataFrame([("p", "start", 1, 1), ("p", "start", 5, 2), ("p", "end", 9, 3), ("q", "start", 1, 4)], "phase string, status string, timestamp long, seq long")
    assert [tuple(r) for r in stats.timing_rollup(log).collect()] == [("p", 4)]


def test_histogram_like_numpy(spark):
    values = np.random.default_rng(2).normal(size=500).round(2)
    got = {r.bin: r.n for r in stats.histogram(numbers(spark, values), "v", 17).collect()}
    want = np.histogram(values, 17)[0]
    assert [got[k] for k in range(17)] == want.tolist()


def test_histogram_of_odd_values(spark):
    values = [1.0, 2.0, 9.0, float("nan"), float("inf"), 9.0]
    rows = numbers(spark, values).unionByName(spark.createDataFrame([("k", None, 9)], "g string, v double, i long"))
    got = sorted(stats.histogram(rows, "v", 8, density=True).collect(), key=lambda r: r.bin)
    density, edges = np.histogram([1.0, 2.0, 9.0, 9.0], 8, density=True)
    assert [r.n for r in got] == [1, 1, 0, 0, 0, 0, 0, 2] and [r.density for r in got] == pytest.approx(density.tolist()) and [r.left_edge for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r.n for r in stats.histogram(numbers(spark, [4.0, 4.0]), "v", 2, density=True).orderBy("bin").collect()] == [2, 0]
    assert stats.histogram(numbers(spark, [float("nan")]), "v", 4).count() == 0


def test_percentiles_like_numpy(spark):
    values = np.random.default_rng(8).normal(size=101).round(3)
    got = ranking.percentiles(numbers(spark, values), ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.333, "d": 1.0}).head()
    assert (got.a, got.b, got.c, got.d) == pytest.approx(tuple(np.percentile(values, [5, 50, 33.3, 100])))
    r = stats.component_stats(numbers(spark, [1.0, float("nan"), float("inf"), 3.0]), ["g"], "v").head()
    assert (r.mean, r.std, r.p50) == (2.0, 1.0, 2.0)


def test_empty_summaries(spark):
    empty = numbers(spark, [1]).limit(0)
    r = stats.component_stats(empty, [], "v").head()
    assert tuple(r) == (0.0,) * 5
    assert empty.agg(stats.rate(F.count_if(F.col("v") > 0), F.count("*")).alias("x")).head().x == 0


def test_gates(spark):
    rows = spark.createDataFrame([("1",), ("",), (None,)], "s string")
    assert gates.fail_rate_gate(rows, "s", 0.5, "fail") == (False, pytest.approx(2 / 3), 2, 3)
    assert gates.fail_rate_gate(rows, "s", 0.5, "warn").passed
    assert gates.fail_rate_gate(rows.limit(0), "s", 0.5).passed
    assert gates.spread_gate(0.05) and not gates.spread_gate(None)
    with pytest.raises(gates.GateError):
        gates.at_least("pairs", 1, 2)
    assert gates.best_path(None, "a", "b", exists=lambda p: p == "b") == "b"


def test_phases(spark, tmp_path):
    phases, calls = gates.Phases(spark, f"file://{tmp_path}"), []
    work = lambda: calls.append(1)
    assert phases.run("one", work) and not phases.run("one", work)
    assert not phases.done("two")
    states = iter([False, True])
    assert phases.run("one", work, lambda: next(states))
    assert len(calls) == 2


def test_low_rank_merge(spark):
    rng = np.random.default_rng(5)
    w, b, a = rng.normal(size=(4, 3)), rng.normal(size=(4, 2)), rng.normal(size=(2, 3))
    frame = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double")
    got = np.zeros_like(w)
    for r in merged_weights(frame(w), frame(b), frame(a), 16.0, 2).collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, w + b @ a * 8)


SALT = """data_NaCl
_cell_length_a 4.0
_cell_length_b 4.0
_cell_length_c 4.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_symmetry_space_group_name_H-M 'P m -3 m'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 0 0 0
Cl1 0.5 0.5 1.5
"""


def test_structures(spark):
    rows = spark.createDataFrame([(SALT,), ("data_x\nnothing",), ("no block",), (None,), (SALT.replace("90\n_cell_angle_beta", "200\n_cell_angle_beta"),)], "t string").withColumn("s", crystal.wrapped(crystal.parsed("t")))
    got = rows.select(crystal.invalid_reason(F.col("t"), F.col("s")), crystal.volume(F.col("s")), crystal.density(F.col("s")), F.lit(0), F.col("s.spacegroup"), F.col("s.sites")).collect()
    assert [r[0] for r in got] == [None, "parse_error", "no_data_block", "no_data_block", "invalid_lattice_angle"]
    assert got[0][1] == pytest.approx(64.0) and got[0][2] == pytest.approx((22.990 + 35.45) * 1.66053906660 / 64)
    sites = crystal.exploded_sites(rows.where(crystal.invalid_reason(F.col("t"), F.col("s")).isNull()), ["t"], "s")
    measured = neighbours.geometry(sites, ["t"]).head()
    assert measured.min_distance == pytest.approx(math.sqrt(12)) and measured.mean_cn == 0 and measured.n_sites == 2
    assert got[0][4] == "P m -3 m" and got[0][5][1].z == 0.5


def edges_of(a, b, c, alpha, beta, gamma):
    ca, cb, cg, sg = math.cos(math.radians(alpha)), math.cos(math.radians(beta)), math.cos(math.radians(gamma)), math.sin(math.radians(gamma))
    cy = (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * cy, c * math.sqrt(1 - cb * cb - cy * cy)]])


def plain_pairs(cell, sites, radius):
    """All pairs of sites with all images that the heights of the cell allow."""
    m = edges_of(*cell)
    heights = abs(np.linalg.det(m)) / np.array([np.linalg.norm(np.cross(m[(k + 1) % 3], m[(k + 2) % 3])) for k in range(3)])
    n = np.ceil(radius / heights).astype(int) + 1
    shifts = np.stack(np.meshgrid(*[np.arange(-r, r + 1) for r in n], indexing="ij"), -1).reshape(-1, 3)
    out = []
    for p, x in sites:
        for q, y in sites:
            d = np.linalg.norm((np.array(y) % 1 - np.array(x) % 1 + shifts) @ m, axis=1)
            out += [(p, q, round(float(v), 7)) for v in d[(d <= radius) & ((p != q) | (d > 1e-8))]]
    return sorted(out)


SITES = "k string, site int, x double, y double, z double, a double, b double, c double, alpha double, beta double, gamma double"
CELLS = {
    "cube": (5.1, 5.1, 5.1, 90, 90, 90), "flat": (0.31, 6.0, 7.0, 90, 90, 90), "skewed": (9.3, 8.7, 6.1, 90, 90, 7), "needle": (40.7, 1.3, 1.7, 80, 95, 120),
    "sheared": (6.0, 30.0, 30.0, 12, 81, 83), "large": (61.0, 73.0, 55.0, 88, 92, 91), "obtuse": (4.9, 5.3, 6.7, 100, 110, 115),
}


def test_periodic_pairs_against_all_images(spark):
    rng = random.Random(11)
    sites = {k: [(n, [rng.uniform(-2, 2) for _ in range(3)]) for n in range(12 if k != "large" else 60)] for k in CELLS}
    sites["cube"] += [(100, [0.0, 0.0, 0.0]), (101, [1.0, 0.0, -3.0])]  # two sites at one place
    rows = [(k, n, *x, *map(float, CELLS[k])) for k, own in sites.items() for n, x in own]
    rows += [("null", 0, None, 0.1, 0.1, *map(float, CELLS["cube"])), ("no volume", 0, 0.1, 0.1, 0.1, 5.0, 5.0, 5.0, 90.0, 90.0, 0.0), ("not finite", 0, float("inf"), 0.1, 0.1, *map(float, CELLS["cube"])), (None, 0, 0.1, 0.1, 0.1, *map(float, CELLS["cube"]))]
    got = neighbours.periodic_pairs(spark.createDataFrame(rows, SITES).repartition(4), ["k"], 3.9).collect()
    for k, own in sites.items():
        found = sorted((r.site, r.other, round(r.distance, 7)) for r in got if r.k == k)
        want = plain_pairs(CELLS[k], own, 3.9)
        assert [x[:2] for x in found] == [x[:2] for x in want], k
        assert np.allclose([x[2] for x in found], [x[2] for x in want], atol=2e-7), k
    assert {r.k for r in got} <= set(sites)


def test_small_structures_meet_without_a_grid(spark, monkeypatch):
    """Neither images nor home sites of small structures are shuffled; larger ones, by the grid, have the same pairs."""
    rng = random.Random(5)
    rows = [(k, n, *[rng.uniform(-2, 2) for _ in range(3)], *map(float, CELLS[k])) for k, most in (("cube", 7), ("flat", 3), ("skewed", 15), ("large", 40)) for n in range(most)]
    df = spark.createDataFrame([*rows, (None, 0, *rows[0][2:]), ("odd", 0, None, *rows[0][3:])], SITES)
    plan = neighbours.periodic_pairs(df, ["k"], 3.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "__gx" not in plan and "Join" not in plan
    found = []
    for most in (100, 10, 0):
        monkeypatch.setattr(neighbours, "WHOLE", most)
        found.append((sorted(map(tuple, neighbours.periodic_pairs(df, ["k"], 3.9).collect())), sorted(map(tuple, neighbours.geometry(df, ["k"]).collect()), key=str)))
    for pairs, shapes in found[1:]:
        assert [x[:3] for x in pairs] == [x[:3] for x in found[0][0]] != [] and [x[3] for x in pairs] == pytest.approx([x[3] for x in found[0][0]])
        assert [x[:2] for x in shapes] == [x[:2] for x in found[0][1]] and str(shapes) == str(found[0][1])


def test_geometry_of_flat_and_odd_cells(spark):
    rows = [("flat", n, 0.5 * n, 0.5 * n, 0.5 * n, 0.0101, 4.0, 4.0, 90.0, 90.0, 90.0) for n in range(2)]
    rows += [("none", 0, 0.0, 0.0, 0.0, 5.0, 5.0, 5.0, 90.0, 90.0, 0.0), ("part", 0, 0.0, 0.0, 0.0, 5.0, 5.0, 5.0, 90.0, 90.0, 90.0), ("part", 1, None, 0.0, 0.0, 5.0, 5.0, 5.0, 90.0, 90.0, 90.0), ("far", 0, 0.0, 0.0, 0.0, 50.0, 50.0, 50.0, 90.0, 90.0, 90.0)]
    got = {r.k: r for r in neighbours.geometry(spark.createDataFrame(rows, SITES), ["k"]).collect()}
    assert got["flat"].min_distance == pytest.approx(math.sqrt(8 + 0.00505**2))
    assert got["flat"].mean_cn == 2 * 297 + 4 * 2 * 99  # its own images along the edge, and the other site's on four sides
    assert got["none"].min_distance is None and got["none"].mean_cn is None and got["part"].max_cn is None
    assert got["far"].min_distance is None and got["far"].mean_cn == 0 and got["far"].n_sites == 1
    assert neighbours.geometry(spark.createDataFrame([], SITES), ["k"]).collect() == []


def test_periodic_join_is_one_of_keys_in_the_jvm(spark):
    rows = spark.createDataFrame([("x", 0, 0.1, 0.1, 0.1, *map(float, CELLS["cube"]))], SITES)
    plan = neighbours.geometry(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cross" not in plan


def test_percentiles_of_tied_values(spark):
    """Nine values over 64 partitions: what is sorted is one row a value, however many rows have it."""
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") % 9 / 100.0).alias("v"), (F.col("id") % 9).alias("w"))
    values = [r.v for r in rows.collect()]
    work = scratch.Workspace(spark, "ties")
    ranking.cumulated(rows, ["k"], "v", work)
    assert spark.read.parquet(work.at("counts")).count() == 9
    got = ranking.percentiles(rows, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).head()
    assert [got.p10, got.p50, got.p90] == pytest.approx(np.percentile(values, [10, 50, 90]).tolist())
    ranks = {(r.v, round(r.pr, 9)) for r in ranking.percentile_rank(rows, ["k"], "v").collect()}
    assert ranks == {(v, round(sum(x < v for x in values) / (len(values) - 1), 9)) for v in set(values)}
    assert ranking.bottom_mean(rows, ["k"], "v", 0.3).head().fallback == pytest.approx(np.mean(sorted(values)[: int(len(values) * 0.3)]))


def test_exact_mean_of_a_tie(spark):
    """Sums of doubles in the order of values miss the last digit of this mean."""
    rows = spark.range(60_000).select((F.col("id") % 11 / 100.0).alias("v")).where("id < 0 or v >= 0")
    got = rows.agg(stats.exact_mean("v").alias("m"), F.sum((F.col("v") * 100).cast("int")).alias("s")).head()
    assert got.m == got.s / 100 / 60_000
    odd = spark.createDataFrame([(1e30,), (3e30,)], "v double")
    assert odd.agg(stats.exact_mean("v").alias("m")).head().m == 2e30
    assert spark.createDataFrame([], "v double").agg(stats.exact_mean("v").alias("m")).head().m is None


def test_files_by_extension(spark):
    rows = spark.createDataFrame([("a/x.PNG",), ("y.png",), ("z",)], "path string")
    assert {r.extension: r.n for r in stats.extension_counts(rows).collect()} == {"png": 2, "": 1}


def test_epochs(spark):
    rows = sampling.epochs(spark.range(5), 3, 1, "id")
    assert rows.count() == 15 and rows.select("shuffle_key").distinct().count() == 15


def test_scorer_marks_failures(spark):
    def score(batch):
        if (batch["x"] < 0).any():
            raise ValueError("negative")
        return batch["x"] * 2.0

    rows = crystal.scored(spark.createDataFrame([(1.0,), (-1.0,), (3.0,)], "x double").coalesce(1), score).collect()
    assert [(r.score_e_per_atom, r.error_type) for r in rows] == [(2.0, None), (None, "ValueError"), (6.0, None)]
