"""Queries of texts, vectors and sequences, and the seams for functions of one's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelode.functions import expressions as E
from tidelode.functions.low_rank import merged_weights
from tidelode.operators import crystal, neighbours, reduction
from tidelode.plans.common import r6, table
from tidelode.scratch import Workspace
from tidelode.sources import sinks
from tidelode.sources.named_files import read_manifest
from tidelode.streaming.state import novelty_stream


def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the mean of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    places = vectors.select("label", F.posexplode("embedding").alias("k", "x"))
    means = places.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p.m).alias("centre"))
    return vectors.join(centre, "label").select("vec_id", r6(E.cosine_similarity("embedding", "centre"), "cosine"))


def element_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each part's type against those of its brand: missing, extra, and the composition score."""
    letters = lambda c: F.array_sort(F.array_distinct(F.split(c, "")))
    rows = table(spark, sf_dir, "part").select("p_partkey", letters(F.col("p_type")).alias("t"), letters(F.upper("p_name")).alias("g"))
    score = E.r_comp(F.lit(False), F.lit(0.9), F.col("t"), F.col("g"))
    return rows.select("p_partkey", F.size(F.array_except("t", "g")).alias("missing"), F.size(F.array_except("g", "t")).alias("extra"), F.array_join(F.array_sort(F.array_union("t", "g")), "").alias("all_letters"), r6(score, "r_comp"))


def neighbour_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector the others of its structure within a distance: how many, and the nearest.

    A hundred vectors in a row stand for the sites of a structure, which has a bounded number of them, so the
    join by structure grows with the table and not with its square.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("structure"), "embedding")
    other = v.select(F.col("vec_id").alias("other_id"), "structure", F.col("embedding").alias("other"))
    square = F.aggregate(F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    near = v.join(other, "structure").where("vec_id <> other_id").withColumn("d", F.sqrt(square)).where("d <= 1.35")
    return near.groupBy("vec_id").agg(F.count("*").alias("neighbours"), r6(F.min("d"), "nearest"))


def prompt_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of formulas made from parts, multiplied by their formula units."""
    count = lambda n: F.when(n == 1, "").otherwise(n.cast("string"))
    k, size = F.col("p_partkey"), F.col("p_size")
    formula = F.concat(F.lit("Li"), count(size % 3 + 1), F.lit("Fe"), count(k % 2 + 1), F.lit("P"), F.lit("O"), count(size % 12 + 1))
    rows = table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula"), (k % 5 + 1).cast("int").alias("z"))
    return rows.select("p_partkey", "formula", "z", E.build_prompt("formula", F.col("z")).alias("prompt"))


def data_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made to look like structure texts, cut to their first block and without its header."""
    body = F.concat(F.lit("# made\ndata_"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nDATA_next\nrest"))
    block = E.first_data_block("body")
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.md5(block).alias("block"), F.md5(E.strip_data_header(block)).alias("content"), F.length(E.strip_data_header(F.col("body"))).cast("bigint").alias("unchanged"))


def garbage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the commonest character in the first lines of documents of many lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", E.char_ratio("text").alias("ratio"))
    return docs.select("doc_id", r6("ratio"), (F.col("ratio") > crystal.MOST_REPEATED).alias("garbage"))


def text_scalar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with title, cut text, JSON and clipped size; times of their numbers."""
    pages = table(spark, sf_dir, "pages")
    n = F.length("html").cast("bigint")
    packed = F.to_json(F.struct(F.col("page_id").alias("id"), n.alias("n")))
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.left("html", F.lit(60)).alias("head"),
        packed.alias("packed"),
        F.get_json_object(packed, "$.n").cast("bigint").alias("unpacked"),
        E.clip(n / 1000.0, 0.5, 2.0).alias("clipped"),
        E.flag_below(F.col("page_id").cast("double") % 100).alias("flag"),
        F.date_format(F.timestamp_seconds(F.col("page_id") * 86400), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


def sequence_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as token sequences: mean over a completion, clamped, padded and shifted."""
    v = table(spark, sf_dir, "embeddings")
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int"))
    return v.select(
        "vec_id",
        r6(E.completion_logp("embedding", F.col("label")), "logp"),
        F.array_join(F.transform(E.clamp_ids(ids, 100), lambda x: x.cast("string")), ",").alias("clamped"),
        F.array_join(F.transform(E.pad_right(ids, 66, F.lit(0)), lambda x: x.cast("string")), ",").alias("padded"),
        F.array_join(F.transform(E.shifted_targets(ids, 65), lambda x: x.cast("string")), ",").alias("targets"),
    )


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling settings of the first six attempts at each part, from settings of its own."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (0.6 + F.col("p_size") / 50.0).alias("t"), F.col("p_size").cast("int").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("attempt"))
    s = E.backoff(F.col("attempt"), F.col("t"), F.col("k"))
    return rows.select("p_partkey", "attempt", r6(s.temperature, "temperature"), s.top_k.alias("top_k"))


def lora_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight matrix of nations by regions with a low-rank update from their keys."""
    nations = table(spark, sf_dir, "nation")
    w = nations.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), F.lit(1.0).alias("v"))
    b = nations.select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") % 2).alias("j"), (F.col("n_nationkey") / 10.0).alias("v"))
    a = table(spark, sf_dir, "region").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.col("r_regionkey").alias("j"), ((F.col("r_regionkey") + 1) / 4.0).alias("v"))
    return merged_weights(w, b, a, 16.0, 2).select("i", "j", r6("v"))


def stream_state_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream: whether type and user occurred among the 200 before."""
    work = Workspace(spark, "stream-novelty")
    arrivals = work.write(table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", "event_type", "user_id").alias("key")), "arrivals")
    source = spark.readStream.schema(arrivals.schema).parquet(work.at("arrivals"))
    return novelty_stream(spark, source, "key", "event_id", 200, work.at("state")).select("event_id", "duplicate_flag")


def mapinpandas_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by a function of a batch, in place of an energy model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return crystal.scored(docs, lambda batch: batch["text"].str.len() / 1000.0).drop("text", "error")


@F.udtf(returnType=T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())]))
class DataBlocks:
    """The first lines of blocks of a text, as a table function."""

    def eval(self, text: str):
        for k, line in enumerate((text or "").split("\n")):
            if line.lstrip().lower().startswith("data_"):
                yield k, line


def udtf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents with two of them each, by a table function over a lateral join."""
    body = F.concat(F.lit("data_"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nDATA_next"))
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return docs.lateralJoin(DataBlocks(F.col("body").outer())).select("doc_id", "line_no", "line")


_CELL = "data_t\n_cell_length_a {a}\n_cell_length_b 4.0\n_cell_length_c 4.0(1)\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\n_symmetry_space_group_name_H-M 'P m -3 m'\nloop_\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nNa 0 0 0\nCl 0.5 0.5 1.5\n"


def structure_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure texts made from parts, parsed, validated and measured."""
    text = F.replace(F.lit(_CELL), F.lit("{a}"), F.format_string("%.1f", (F.col("p_size") - 1) / 5.0))
    # dealt out first: a file of few bytes a row is one task's, and each row has a text to parse
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).repartition(4 * spark.sparkContext.defaultParallelism).withColumn("s", crystal.wrapped(crystal.parsed("text")))
    valid = crystal.invalid_reason(F.col("text"), F.col("s"))
    rows = rows.select("p_partkey", valid.alias("reason"), r6(crystal.volume(F.col("s")), "volume"), crystal.n_elements(F.col("s")).alias("n_elements"), r6(F.round(F.col("s.sites")[1].z, 6), "z"), "s")
    rows = Workspace(spark, "structures").write(rows, "parsed")  # parsed once, measured by a join
    measured = neighbours.geometry(crystal.exploded_sites(rows.where("reason is null"), ["p_partkey"], "s"), ["p_partkey"])
    return rows.drop("s").join(measured.drop("n_sites"), "p_partkey", "left").select("p_partkey", "reason", "volume", "n_elements", "z", *[r6(c) for c in ("min_distance", "mean_cn", "max_cn")])


def periodic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sites of the structure of their part, in cells from cubes to flat and skewed ones."""
    k = F.col("l_partkey")
    part = lambda c, n: (F.col(c) * 7919 % int(n)) / n
    of = lambda each, angles: F.element_at(F.array(*[F.lit(x) for x in angles]), (F.floor(k / each) % len(angles) + 1).cast("int"))
    numbers = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    # numbered first, so that only the table's own columns are shuffled
    items = table(spark, sf_dir, "lineitem").select("l_partkey", *numbers, F.row_number().over(Window.partitionBy("l_partkey").orderBy(*numbers)).alias("site")).select(
        "l_partkey", "site", part("l_orderkey", 1009.0).alias("x"), (part("l_linenumber", 101.0) + part("l_suppkey", 97.0)).alias("y"), (F.col("l_extendedprice") / 1777.0).alias("z"),
        (7.31 + k % 5).alias("a"), (6.17 + k % 7).alias("b"), (8.23 + k % 3).alias("c"),
        of(5, (90.0, 75.0, 100.0)).alias("alpha"), of(4, (90.0, 80.0)).alias("beta"), of(6, (90.0, 120.0, 25.0, 150.0)).alias("gamma"),
    )
    got = neighbours.geometry(items, ["l_partkey"])
    return got.select("l_partkey", "n_sites", *[r6(c) for c in ("min_distance", "mean_cn", "max_cn")])


def reduced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's cell, which every line item holds changed by shears of its own: whether all reduce to one cell, and its volume."""
    k, p, q = F.col("l_partkey"), F.col("p"), F.col("q")
    of = lambda c, n, m: (c * 7919 % n) / float(m)
    cells = table(spark, sf_dir, "lineitem").select(
        "l_partkey", (F.col("l_linenumber") % 5 - 2).alias("p"), (F.col("l_orderkey") % 7 - 3).alias("q"), (4.1 + of(k, 101, 97)).alias("a"), (5.3 + of(k, 211, 199)).alias("b"), (6.7 + of(k, 307, 293)).alias("c"),
        F.cos(F.radians(72.0 + of(k, 31, 3))).alias("ca"), F.cos(F.radians(76.0 + of(k, 29, 3))).alias("cb"), F.cos(F.radians(81.0 + of(k, 23, 3))).alias("cg"),
    )
    bc, ac, ab = F.col("b") * F.col("c") * F.col("ca"), F.col("a") * F.col("c") * F.col("cb"), F.col("a") * F.col("b") * F.col("cg")
    sq = lambda c: F.col(c) * F.col(c)
    # b goes to b + p a, then c to c + q b
    b2, ab2, bc2 = sq("b") + 2 * p * ab + p * p * sq("a"), ab + p * sq("a"), bc + p * ac
    c2, ac2, bc3 = sq("c") + 2 * q * bc2 + q * q * b2, ac + q * ab2, bc2 + q * b2
    angle = lambda dot, u, v: F.degrees(F.acos(dot / F.sqrt(u * v)))
    sheared = cells.select("l_partkey", "a", F.sqrt(b2).alias("b"), F.sqrt(c2).alias("c"), angle(bc3, b2, c2).alias("alpha"), angle(ac2, sq("a"), c2).alias("beta"), angle(ab2, sq("a"), b2).alias("gamma"))
    cell = sheared.select("l_partkey", reduction.niggli(*neighbours.CELL).alias("n")).select("l_partkey", "n.*")
    same = [F.max(c) - F.min(c) < 1e-6 for c in neighbours.CELL]
    ordered = F.bool_and((F.col("a") <= F.col("b") + 1e-6) & (F.col("b") <= F.col("c") + 1e-6))
    return cell.groupBy("l_partkey").agg(F.count("a").alias("n"), reduce(lambda x, y: x & y, same).alias("one_cell"), ordered.alias("ordered"), r6(F.round(F.avg(crystal.volume(F.struct(*neighbours.CELL))), 5), "volume"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their own in folders of their languages, and what the files hold when read again."""
    work = Workspace(spark, "named-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"), F.format_string("%08d.cif", "doc_id").alias("file"))
    sinks.copy_routed(docs.repartition(spark.sparkContext.defaultParallelism), work.at("files"), F.col("lang"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cif").load(work.at("files"))
    parts = F.split("path", "/")
    read = found.select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"))
    listed = read_manifest(spark, work.at("files")).select("doc_id", "folder", "name", F.col("sha256").alias("said"))
    return read.join(listed, ["folder", "name"], "full").select("doc_id", "folder", "name", "n_bytes", "content_sha256", (F.col("said") == F.col("content_sha256")).alias("as_listed"))


def space_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure texts made from parts by the space group that they declare, the empty one for those without."""
    head = F.when(F.col("p_size") % 4 == 0, F.lit("data_t\n")).otherwise(F.concat(F.lit("data_t\n_symmetry_space_group_name_H-M  '"), "p_brand", F.lit("' \n")))
    text = F.concat(head, F.lit("_cell_length_a 4.0\n_symmetry_space_group_name_H-M 'second'\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", E.space_group(text).alias("space_group"))
    return rows.groupBy("space_group").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"))


QUERIES = {f.__name__: f for f in (
    cosine_similarity, element_penalty, neighbour_range_join, periodic_neighbours, prompt_formula, data_block_extract, garbage_ratio, text_scalar_pack, sequence_ops, backoff_schedule, lora_merge, stream_state_novelty,
    mapinpandas_scorer, udtf_blocks, structure_validation, space_groups, reduced_cells, named_files,
)}

ORACLE_SQL = {
    "cosine_similarity": """
        with p as (select label, k, avg(embedding[k]::double) as m from embeddings, unnest(range(1, 65)) as t(k) group by label, k),
        c as (select label, list(m order by k) as centre from p group by label)
        select vec_id, round(list_cosine_similarity(embedding::double[], centre), 6) as cosine from embeddings join c using (label)""",
    "element_penalty": """
        with s as (select p_partkey, list_distinct(string_split(p_type, '')) as t, list_distinct(string_split(upper(p_name), '')) as g from part),
        x as (select *, len(list_filter(t, lambda v: not list_contains(g, v))) as missing, len(list_filter(g, lambda v: not list_contains(t, v))) as extra from s)
        select p_partkey, missing::int as missing, extra::int as extra, array_to_string(list_sort(list_distinct(list_concat(t, g))), '') as all_letters,
               round(greatest(0, 0.9::double - (0.35 * missing / len(t) + 0.25 * extra / len(g))), 6) as r_comp
        from x""",
    "neighbour_range_join": """
        with n as (
          select a.vec_id, list_distance(a.embedding::double[], b.embedding::double[]) as d
          from embeddings a join embeddings b on a.vec_id // 100 = b.vec_id // 100 and a.vec_id <> b.vec_id)
        select vec_id, count(*) as neighbours, round(min(d), 6) as nearest from n where d <= 1.35 group by vec_id""",
    # all pairs of sites with all images that can be near
    "periodic_neighbours": """
        with s as (
          select l_partkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as site, (l_orderkey * 7919 % 1009) / 1009.0::double as x,
                 (l_linenumber * 7919 % 101) / 101.0::double + (l_suppkey * 7919 % 97) / 97.0::double as y, l_extendedprice / 1777.0::double as z from lineitem),
        cells as (
          select distinct l_partkey, 7.31::double + l_partkey % 5 as a, 6.17::double + l_partkey % 7 as b, 8.23::double + l_partkey % 3 as c,
                 cos(radians(([90, 75, 100])[l_partkey // 5 % 3 + 1])) as ca, cos(radians(([90, 80])[l_partkey // 4 % 2 + 1])) as cb, radians(([90, 120, 25, 150])[l_partkey // 6 % 4 + 1]) as g from s),
        edged as (
          select l_partkey, a, b * cos(g) as bx, b * sin(g) as by_, c * cb as cx, c * (ca - cb * cos(g)) / sin(g) as cy, c * sqrt(1 - cb * cb - pow((ca - cb * cos(g)) / sin(g), 2)) as cz from cells),
        steps as (select i, j, k from unnest(range(-3, 4)) as t(i), unnest(range(-3, 4)) as u(j), unnest(range(-2, 3)) as v(k)),
        p as (select l_partkey, site, x - floor(x) as x, y - floor(y) as y, z - floor(z) as z from s),
        n as (
          select l_partkey, p.site, q.site as other, q.x - p.x + i as x, q.y - p.y + j as y, q.z - p.z + k as z
          from p join p q using (l_partkey), steps),
        near as (
          select l_partkey, site, other, sqrt(pow(x * a + y * bx + z * cx, 2) + pow(y * by_ + z * cy, 2) + pow(z * cz, 2)) as d from n join edged using (l_partkey)),
        each as (
          select l_partkey, site, min(d) filter (site <> other and d <= 4) as least, count(*) filter (d <= 3) as cn
          from near where site <> other or d > 1e-8 group by l_partkey, site)
        select l_partkey, count(*) as n_sites, round(min(least), 6) as min_distance, round(sum(cn) / count(*), 6) as mean_cn, max(cn)::double as max_cn from each group by l_partkey""",
    "prompt_formula": """
        with n as (select p_partkey, p_size % 3 + 1 as li, p_partkey % 2 + 1 as fe, p_size % 12 + 1 as o, (p_partkey % 5 + 1)::int as z from part)
        select p_partkey, 'Li' || case when li = 1 then '' else li::varchar end || 'Fe' || case when fe = 1 then '' else fe::varchar end || 'PO' || case when o = 1 then '' else o::varchar end as formula, z,
               'data_Li' || case when li * z = 1 then '' else (li * z)::varchar end || 'Fe' || case when fe * z = 1 then '' else (fe * z)::varchar end || 'P' || case when z = 1 then '' else z::varchar end
               || 'O' || case when o * z = 1 then '' else (o * z)::varchar end as prompt from n""",
    "data_block_extract": """
        select doc_id, md5('data_' || doc_id || chr(10) || text) as block, md5(text) as content,
               length('# made' || chr(10) || 'data_' || doc_id || chr(10) || text || chr(10) || 'DATA_next' || chr(10) || 'rest') as unchanged
        from documents""",
    "garbage_ratio": """
        with h as (
          select doc_id, len(string_split(text, chr(10))) as n_lines, array_to_string(string_split(text, chr(10))[1:50], '') as head from documents),
        c as (select doc_id, ch, count(*) as n from h, unnest(string_split(head, '')) as t(ch) where head <> '' group by all),
        m as (select doc_id, max(n) as n from c group by doc_id),
        r as (select h.doc_id, case when n_lines > 10 and m.n is not null then m.n / length(head) else 0.0 end as ratio from h left join m using (doc_id))
        select doc_id, round(ratio, 6) as ratio, ratio > 0.5 as garbage from r""",
    "text_scalar_pack": """
        select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html[1:60] as head, '{"id":' || page_id || ',"n":' || length(html) || '}' as packed,
               length(html) as unpacked, greatest(0.5::double, least(2.0::double, length(html) / 1000)) as clipped, printf('%.1f%%', (page_id % 100)::double) || case when page_id % 100 < 50 then ' LOW' else '' end as flag,
               strftime(to_timestamp(page_id * 86400) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as "at"
        from pages""",
    "sequence_ops": """
        with x as (select vec_id, label, embedding, list_transform(embedding, lambda v: floor(abs(v::double) * 1000)::int) as ids from embeddings)
        select vec_id, round(list_avg(list_transform(embedding[greatest(label - 1, 0) + 1 : 64], lambda v: v::double)), 6) as logp,
               array_to_string(list_transform(ids, lambda v: least(v, 99)), ',') as clamped, array_to_string(list_concat(ids, [0, 0]), ',') as padded,
               array_to_string(list_concat(ids[2:64], [-1, -1]), ',') as targets
        from x""",
    "structure_validation": """
        with s as (select p_partkey, round((p_size - 1) / 5.0::double, 1) as a from part),
        m as (
          select *, case when a <= 0 then 'negative_lattice_length' end as reason, sqrt((a / 2) * (a / 2) + 8) as d,
                 case when a > 0 then 2 * floor(3.0::double / a) + 8 * len(list_filter(range(0, 60), lambda i: (i + 0.5) * a <= 1.0 + 1e-9)) end as cn
          from s)
        select p_partkey, reason, round(a * 16, 6) as volume, 2 as n_elements, 0.5::double as z, case when reason is null and d <= 4 then round(d, 6) end as min_distance,
               case when reason is null then cn::double end as mean_cn, case when reason is null then cn::double end as max_cn
        from m""",
    # shears keep the volume, so it is the one of the part's own cell
    "reduced_cells": """
        with c as (
          select l_partkey, 4.1::double + (l_partkey * 7919 % 101) / 97.0::double as a, 5.3::double + (l_partkey * 7919 % 211) / 199.0::double as b, 6.7::double + (l_partkey * 7919 % 307) / 293.0::double as c,
                 cos(radians(72.0::double + (l_partkey * 7919 % 31) / 3.0::double)) as ca, cos(radians(76.0::double + (l_partkey * 7919 % 29) / 3.0::double)) as cb,
                 cos(radians(81.0::double + (l_partkey * 7919 % 23) / 3.0::double)) as cg from lineitem)
        select l_partkey, count(*) as n, true as one_cell, true as ordered, round(a * b * c * sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg), 5) as volume
        from c group by l_partkey, a, b, c, ca, cb, cg""",
    "named_files": """
        select doc_id, coalesce(lang, 'none') as folder, printf('%08d.cif', doc_id) as name, strlen(coalesce(text, '')) as n_bytes, sha256(coalesce(text, '')) as content_sha256, true as as_listed from documents""",
    "space_groups": """
        select chr(39) || case when p_size % 4 = 0 then 'second' else p_brand end || chr(39) || case when p_size % 4 = 0 then '' else ' ' end as space_group, count(*) as n, min(p_partkey) as first_seen from part group by all""",
    "backoff_schedule": """
        with recursive s(p_partkey, attempt, t, k) as (
          select p_partkey, 1, 0.6::double + p_size / 50.0::double, p_size::int from part
          union all select p_partkey, attempt + 1, greatest(0.6::double, t * 0.8::double), greatest(5, k // 2)::int from s where attempt < 6)
        select p_partkey, attempt::int as attempt, round(t, 6) as temperature, k::int as top_k from s""",
    "stream_state_novelty": """
        with s as (select event_id, event_type || '|' || user_id as k, row_number() over (order by event_id) as pos from events)
        select event_id, (case when pos - lag(pos) over (partition by k order by pos) <= 200 then 1 else 0 end)::int as duplicate_flag from s""",
    "mapinpandas_scorer": "select doc_id, length(text) / 1000 as score_e_per_atom, null::varchar as error_type from documents",
    "udtf_blocks": """
        with x as (select doc_id, 'data_' || doc_id || chr(10) || text || chr(10) || 'DATA_next' as body from documents),
        l as (select doc_id, unnest(range(len(string_split(body, chr(10)))))::int as line_no, unnest(string_split(body, chr(10))) as line from x)
        select * from l where starts_with(lower(ltrim(line)), 'data_')""",
    "lora_merge": """
        with u as (
          select n_nationkey as i, r_regionkey as j, (n_nationkey / 10) * ((r_regionkey + 1) / 4) * 8 as v from nation, region)
        select i, j, round(sum(v), 6) as v from (select * from u union all select n_nationkey, n_regionkey, 1.0 from nation) group by i, j""",
}
