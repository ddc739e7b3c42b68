"""Sources and sinks on edge rows, and state across batches."""

import hashlib
import http.server
import json
import threading
import urllib.parse

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelode.operators import joins, ranking, reward
from tidelode.plans import reports
from tidelode.sources import hull, sinks, tables
from tidelode.sources import named_files as nf
from tidelode.streaming import state as st


def uri(path):
    return f"file://{path}"


def test_csv_with_quotes_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a.cif", 'he said "x", y\nline2', None), ("b.cif", "", "T")], "file string, error string, valid string")
    sinks.write_csv(rows, uri(tmp_path / "out"), ["file", "error", "valid"])
    got = tables.read_csv(spark, uri(tmp_path / "out"), "file string, error string, valid string, more int").orderBy("file").collect()
    assert tuple(got[0]) == ("a.cif", 'he said "x", y\nline2', None, None)
    assert tuple(got[1]) == ("b.cif", None, "T", None)


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"prompt": "p", "tag": "é"}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tables.read_jsonl(spark, uri(tmp_path / "x.jsonl"), tables.SCHEMAS["pairs"]).collect()
    rows = tables.read_jsonl(spark, uri(tmp_path / "x.jsonl"), tables.SCHEMAS["pairs"], strict=False).where("prompt is not null").collect()
    assert [r.tag for r in rows] == ["é"]
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), uri(tmp_path / "log"), append=True)
    sinks.log_event(spark, uri(tmp_path / "log"), phase="x")
    assert spark.read.json(uri(tmp_path / "log")).count() == 2


def test_targets(spark, tmp_path):
    for t, n in (("A", 2), ("B", 1)):
        (tmp_path / t).mkdir()
        (tmp_path / t / "pairs.jsonl").write_text('{"prompt": "p"}\n' * n)
    rows = tables.read_targets(spark, uri(tmp_path), ["A", "B", "C"], "pairs.jsonl", "prompt string")
    assert {r.source_target: r.n for r in rows.groupBy("source_target").agg(F.count("*").alias("n")).collect()} == {"A": 2, "B": 1}
    assert tables.read_targets(spark, uri(tmp_path), ["C"], "pairs.jsonl", "prompt string").count() == 0


def test_folders_objects_and_paths(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.cif").write_text(f"data_{n}\nx")
    rows = tables.read_structures(spark, uri(tmp_path), most=2).collect()
    assert [r.file for r in rows] == ["a.cif", "b.cif"]
    joined = tables.with_texts(spark.createDataFrame([("a.cif",), ("z.cif",)], "file string"), tables.read_structures(spark, uri(tmp_path)))
    assert {r.file: r.text for r in joined.collect()} == {"a.cif": "data_a\nx", "z.cif": None}
    assert tables.read_object(spark, uri(tmp_path / "none.json"), "a int").head().a is None
    (tmp_path / "o.json").write_text('{\n"a": 3\n}')
    assert tables.read_object(spark, uri(tmp_path / "o.json"), "a int").head().a == 3
    assert tables.first_existing(spark, uri(tmp_path / "none"), uri(tmp_path / "o.json")) == uri(tmp_path / "o.json")


def test_sources(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / f"{n}.csv").write_text("file,formula\na,F\n")
    both = f"{uri(tmp_path / 'x.csv')}, {uri(tmp_path / 'y.csv')}"
    assert tables.read_sources(spark, both, uri(tmp_path), "file string, formula string").count() == 2
    with pytest.raises(ValueError):
        tables.read_sources(spark, both, ["1", "2", "3"], "file string")
    with pytest.raises(FileNotFoundError):
        tables.read_sources(spark, both, "/no/where", "file string")
    assert tables.aligned(["a", "b", "c"], ["1", "2"]) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_settings():
    s = tables.settings({"TARGETS": "X, Y"}, SEED="7")
    assert (tables.targets_of(s), s["SEED"], tables.z_map(s)["NaCl"]) == (["X", "Y"], "7", 4)
    config = {"lora": {"LR": "1"}, "": {"LR": "2", "BETA": "3"}}
    assert [tables.branch_setting(config, *x) for x in (("lora", "LR", "9"), ("full", "LR", "9"), ("full", "Q", "9"))] == ["1", "2", "9"]


def test_hull_table(spark):
    assert tables.hull_table(spark, [("A", 2.0), ("A", 1.0)]).head().hull_energy == 1.0
    assert tables.hull_table(spark, []).count() == 0


def test_other_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", 1, "a.cif", "text"), ("t", "p", 2, "b.cif", None)], "target string, phase string, rank int, file string, text string")
    manifest = sinks.export_ranked(rows, uri(tmp_path / "top"))
    assert [(m.rank, m["name"]) for m in manifest.orderBy("rank").collect()] == [(1, "t_p_01_a.cif"), (2, "t_p_02_b.cif")] and (tmp_path / "top" / "t_p_01_a.cif").read_text() == "text"
    sinks.write_routed(rows, uri(tmp_path / "routed"), F.when(F.col("rank") == 1, "valid").otherwise("invalid"))
    assert (tmp_path / "routed" / "route=valid").is_dir()
    assert not sinks.write_if_any(rows.limit(0), uri(tmp_path / "none"), ["file"]) and sinks.write_if_any(rows, uri(tmp_path / "some"), ["file"])
    assert sinks.write_summary(rows.agg(F.count("*").alias("n"), F.max("text").alias("m")), uri(tmp_path / "s.json")) == {"n": 2, "m": "text"}
    sinks.write_config(spark, uri(tmp_path / "c.json"), {"b": 1})
    assert json.loads((tmp_path / "c.json").read_text()) == {"b": 1}


def test_reports(spark):
    text = reports.three_way("T", {"Stability Rate": (0.1250, 0.1230, 0.1235), "Mean": (float("nan"), 1.0, 2.0)}, "none")
    assert "| Stability Rate | 0.1250 | 0.1230 | 0.1235 | -0.0015 |" in text and "N/A" in text and "does not improve" in text


def test_reports_of_pairs_and_branches(spark):
    text = reports.pair_quality("P", {"n": 3, "gap_mean": 0.5, "gap_p90": float("nan"), "groups": 2, "mean_pairs": 1.5, "least": 1, "most": 2, "std_pairs": 0.5}, ["few pairs"])
    assert "Pairs: 3" in text and "| mean | 0.5000 |" in text and "| p90 | N/A |" in text and "| prompts | 2 |" in text and text.endswith("Warning: few pairs\n")
    rows = spark.createDataFrame([("b", 0.5, 0.75), ("a", None, 0.5)], "branch string, base_rate double, dpo_rate double")
    text = reports.cross_branch("B", rows, "branch", ["base", "dpo"], "rate")
    assert "| a | N/A | 0.5000 | N/A |\n| b | 0.5000 | 0.7500 | +0.2500 |" in text


def test_run_folders(spark, tmp_path):
    import os

    from tidelode import scratch

    with scratch.run_folders():
        work = scratch.Workspace(spark, "folders")
        assert work.write(spark.range(3), "t").count() == 3
        path = work.path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def structures(spark, rows):
    cols = "target string, seq long, e_per_atom double, min_distance double, density double, ref_density double, mean_cn double, max_cn double, same boolean, cosine double, target_elements array<string>, elements array<string>, struct_key string"
    return spark.createDataFrame([("t", i, e, d, 3.5, 3.5, 4.0, 4.0, True, 1.0, ["A"], ["A"], k) for i, (e, d, k) in enumerate(rows)], cols)


def test_state_across_batches(spark, tmp_path):
    state = st.RewardState(spark, uri(tmp_path / "state"), keep_energies=3, keep_keys=2)
    run = lambda v, rows, **kw: {r.seq: r for r in st.process(state, v, structures(spark, rows), reward.Weights(), 10, 0.5, **kw).collect()}
    first = run(0, [(1.0, 1.0, "A"), (2.0, 0.1, "B"), (3.0, 1.0, "A")])
    assert (first[0].r_novel, first[2].r_novel, first[1].r_total, first[1].gate_reason) == (1.0, 0.0, -1.0, "min_distance_below_threshold")
    assert first[2].percentile == 1.0
    assert sorted(r.e_per_atom for r in state.read("energies", 1).collect()) == [1.0, 3.0]
    second = run(1, [(2.0, 1.0, "A"), (9.0, 1.0, "C")])
    assert (second[0].r_novel, second[1].r_novel, second[0].percentile) == (0.0, 1.0, 1.0)
    assert [r.struct_key for r in state.read("keys", 2).orderBy("seq").collect()] == ["A", "C"]
    again = run(1, [(2.0, 1.0, "A"), (9.0, 1.0, "C")])
    assert again[0].r_total == second[0].r_total
    state.reset()
    compat = st.RewardState(spark, uri(tmp_path / "compat"))
    st.process(compat, 0, structures(spark, [(1.0, 1.0, "A"), (2.0, 0.1, "B")]), reward.Weights(), 10, 0.5, compat=True)
    assert sorted(r.e_per_atom for r in compat.read("energies", 1).collect()) == [1.0, 1.0, 2.0]


def test_streams(spark, tmp_path):
    rows = [(1.0, 1.0, "A"), (2.0, 1.0, "B"), (3.0, 1.0, "A")]
    structures(spark, rows).coalesce(1).write.parquet(uri(tmp_path / "in"))
    source = spark.readStream.schema(structures(spark, rows).schema).parquet(uri(tmp_path / "in"))
    st.scored_stream(spark, source, st.RewardState(spark, uri(tmp_path / "state")), uri(tmp_path / "out"), uri(tmp_path / "check"))
    got = spark.read.option("recursiveFileLookup", "true").parquet(uri(tmp_path / "out")).orderBy("seq").collect()
    assert [r.r_novel for r in got] == [1.0, 1.0, 0.0]
    st.appended_log(source.select("target", "seq"), uri(tmp_path / "log"), uri(tmp_path / "check2"))
    assert spark.read.json(uri(tmp_path / "log")).count() == 3


def test_retries(spark, tmp_path):
    def write(df, name):
        df.write.mode("overwrite").parquet(uri(tmp_path / name))
        return spark.read.parquet(uri(tmp_path / name))

    done, left = st.retried(spark.range(10), "id", lambda df, k: df.where(f"id % 4 <= {k}"), 3, write)
    assert (done.count(), sorted(r.id for r in left.collect())) == (8, [3, 7])


def test_daily_counts(spark, tmp_path):
    days = spark.sql("select explode(array('2024-01-01 01:00:00', '2024-01-01 02:00:00', '2024-01-02 01:00:00')) as t").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"))
    days.coalesce(1).write.parquet(uri(tmp_path / "in"))
    found = []
    source = spark.readStream.schema(days.schema).parquet(uri(tmp_path / "in"))
    st.daily_counts(source, uri(tmp_path / "check"), lambda df, _: found.extend(r.n for r in df.collect()))
    assert sorted(found) == [1, 2]


# --- a remote source


@pytest.fixture
def service():
    """A server in this process: pages of entries; some pages fail a few times first, one formula always."""
    entries = {"NaCl": [(-3.0 - k / 100, 0.0) for k in range(7)] + [(-9.0, 0.5)], "TiO2": [(-8.5, 0.0005)], "None": [], "Odd": [("x", 0.0), (-1.0, 0.0)], "Bad": [(-1.0, 0.0)] * 5}
    asked, failing = [], {("NaCl", 3): 2}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            formula, skip, limit = q["formula"], int(q["_skip"]), int(q["_limit"])
            asked.append((formula, skip, float(q["energy_above_hull_max"]), self.headers.get("X-API-KEY")))
            if failing.get((formula, skip), 0) or (formula == "Bad" and skip):
                failing[(formula, skip)] = failing.get((formula, skip), 1) - 1
                self.send_error(503)
                return
            near = [x for x in entries.get(formula, []) if float(q["energy_above_hull_min"]) <= x[1] <= float(q["energy_above_hull_max"])]
            body = json.dumps({"data": [{"energy_per_atom": e, "energy_above_hull": h} for e, h in near[skip : skip + limit]], "meta": {"total_doc": len(near)}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/thermo", asked
    server.shutdown()


def test_remote_hull_pages_retries_and_fallback(spark, service):
    url, asked = service
    scores = spark.createDataFrame([("a", "NaCl", -2.0), ("b", "TiO2", -8.0), ("c", "Bad", -1.0), ("d", "Bad", -3.0), ("e", "None", 1.0), ("f", None, 2.0), ("g", "NaCl", -3.0)], "file string, formula string, e_per_atom double")
    known = hull.remote_hull(spark, scores, url, page_size="3", attempts="3", wait_ms="1", key="secret")
    assert {r.formula: r.hull_energy for r in known.collect()} == {"NaCl": -3.06, "TiO2": -8.5}
    # the page that failed twice was asked for three times; what lies behind a page that always fails gives nothing
    assert [x[:2] for x in asked if x[0] == "NaCl"] == [("NaCl", 0), ("NaCl", 3), ("NaCl", 3), ("NaCl", 3), ("NaCl", 6)]
    assert {x[3] for x in asked} == {"secret"} and {x[2] for x in asked} == {0.001}
    bottom = ranking.bottom_mean(scores.where("formula <> 'None'"), ["formula"], "e_per_atom", 0.5)
    rows = {r.file: (r.hull_ref_e_per_atom, r.ehull_method) for r in joins.hull_reference(scores, known, bottom).collect()}
    assert rows["a"] == (-3.06, "mp_api") and rows["c"] == (-3.0, "fallback_percentile") and rows["e"] == (1.0, "self") and rows["f"] == (2.0, "self")


def test_remote_hull_filters_and_failures(spark, service):
    url, asked = service
    spark.dataSource.register(hull.HullSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda **o: spark.read.format("hull").options(**{"url": url, "formulas": '["NaCl", "TiO2", "Odd", null, "NaCl"]', "wait_ms": "1", "push": "true", **o}).load()
        assert load().where("formula = 'TiO2'").count() == 1 and {x[0] for x in asked} == {"TiO2"}
        asked.clear()
        assert load().where("formula in ('Odd', 'TiO2') and energy_above_hull <= 0.0001").collect() == [("Odd", -1.0, 0.0)]
        assert {x[2] for x in asked} == {0.0001} and {x[0] for x in asked} == {"Odd", "TiO2"}
        assert load().where("energy_per_atom < -8").count() == 1
        # no service, no address, no formulas: no rows
        assert load(url="http://127.0.0.1:9/x", attempts="1").count() == 0
        assert load(url="").count() == 0 and load(formulas="[]").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled") if before is None else spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


# --- named files


def files_below(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc") and "_manifest" not in p.parts and p.name != "manifest.json"}


def test_named_files(spark, tmp_path):
    rows = [("a.cif", "data_a é\r\n", True, 1), ("b.cif", "", False, 2), ("c d.cif", None, True, 3), ("e.cif", "x" * 200_000, False, None)]
    df = spark.createDataFrame(rows, "file string, text string, valid boolean, rank int").repartition(3)
    route = F.when(F.col("valid"), "valid_cifs").otherwise("invalid_cifs")
    nf.write_named_files(df, uri(tmp_path / "out"), "file", "text", route)
    want = {f"{'valid' if v else 'invalid'}_cifs/{n}": (t or "").encode() for n, t, v, _ in rows}
    assert files_below(tmp_path / "out") == want
    listed = {f"{r.folder}/{r.name}": (r.bytes, r.sha256, r.rank) for r in nf.read_manifest(spark, uri(tmp_path / "out")).collect()}
    assert listed == {f"{'valid' if v else 'invalid'}_cifs/{n}": (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), k) for n, t, v, k in rows}
    # bytes as they are, without folders, over an earlier export
    raw = spark.createDataFrame([("a.bin", bytearray(b"\xff\x00\n"))], "name string, body binary")
    nf.write_named_files(raw, uri(tmp_path / "raw"), "name", "body")
    nf.write_named_files(raw.withColumn("body", F.lit(bytearray(b"2"))), uri(tmp_path / "raw"), "name", "body")
    assert files_below(tmp_path / "raw") == {"a.bin": b"2"}
    nf.write_named_files(raw.limit(0), uri(tmp_path / "none"), "name", "body")
    assert nf.read_manifest(spark, uri(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bad", ["", None, "../x", "a/b", ".hidden", "_manifest"])
def test_names_that_are_not_plain(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="plain"):
        nf.write_named_files(spark.createDataFrame([(bad, "x"), ("ok", "y")], "n string, t string"), uri(tmp_path), "n", "t")
    with pytest.raises(ValueError, match="once"):
        nf.write_named_files(spark.createDataFrame([("ok", "x"), ("ok", "y")], "n string, t string"), uri(tmp_path), "n", "t")
    assert files_below(tmp_path) == {}


def test_attempts_that_fail_leave_nothing(tmp_path):
    batch = lambda *names: pa.RecordBatch.from_pylist([{"__folder": "f", "__name": n, "__content": b"1"} for n in names])

    def broken():
        yield batch("a", "b")
        raise RuntimeError("lost")

    writer = nf.NamedFilesWriter(uri(tmp_path), "job")
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert files_below(tmp_path) == {} and not list((tmp_path / "_manifest").rglob("*.jsonl"))
    first = writer.write(iter([batch("a", "b")]))  # the next attempt
    second = writer.write(iter([batch("c")]))
    assert set(files_below(tmp_path)) == {"f/a", "f/b", "f/c"} and not (tmp_path / "manifest.json").exists()
    writer.abort([first, None, second])
    assert files_below(tmp_path) == {}


def test_a_task_that_fails_fails_the_export(spark, tmp_path):
    boom = F.udf(lambda n: 1 // (n != "f7"), "int")
    df = spark.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id")).alias("n"), F.lit("x").alias("t")).withColumn("k", boom("n"))
    with pytest.raises(Exception, match="ZeroDivision"):
        nf.write_named_files(df, uri(tmp_path), "n", "t")
    assert files_below(tmp_path) == {} and not (tmp_path / "manifest.json").exists()
