"""The thin queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the public tokenizers' files, which are read where they lie.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity.

    Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.
    """
    from tidelode.llm.toxicity import toxicity

    grades = _table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") * (2 - F.col("quality"))).alias("grade"))
    return toxicity(spark, _table(spark, sf_dir, "documents"), grades).drop("at_least")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document that links of similar 5-word sets reach."""
    from tidelode.llm.ngram_join import ngram_join

    return ngram_join(spark, _table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its role after the repair, and its piece of the rendering."""
    from tidelode.llm.chat_repair import repaired

    return repaired(spark, _table(spark, sf_dir, "conversations"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the live shards hold it after arrivals and compaction."""
    from tidelode.llm.compaction import sharded

    return sharded(spark, _table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that start elsewhere too."""
    from tidelode.llm.suffix_dedup import repeated_spans

    return repeated_spans(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its evidence, the means of its host and path, and the decision.

    Documents have no URL here: their source is the host, source and language the path.
    """
    from tidelode.llm.quality import quality

    found = quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
    return found.drop("mark")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equal texts."""
    from tidelode.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, _table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens before and after its edits, counted by segment trees.

    The edits take personal data out: each match of an e-mail address, telephone or card number becomes a tag.
    """
    from tidelode.llm.token_tree import edited_counts

    return edited_counts(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best segmentation, the scores of its four best, and whether it decodes."""
    from tidelode.llm.piece_lattice import segmented

    return segmented(spark, _table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside passages of the benchmark."""
    from tidelode.llm.decontaminate import contamination

    found = contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that share the first turns of their hundred."""
    from tidelode.llm.prefix_trie import prefix_trie

    return prefix_trie(spark, _table(spark, sf_dir, "conversations"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of each query, which is every vector whose vec_id is divisible by 100."""
    from tidelode.llm.threshold_search import top_k

    return top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the links between its tokens by two tokenizers."""
    from tidelode.llm.token_align import aligned

    return aligned(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sharding": op4_sharding,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_topk_search": op12_topk_search,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": """
        select doc_id, strlen(coalesce(text, '')) as n_bytes, sha256(coalesce(text, '')) as text_sha256 from documents""",
    "op7_exact_dedup": r"""
        with n as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
        from n window w as (partition by norm)""",
    "op10_benchmark_decontamination": r"""
        with lowered as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
          from documents),
        test as (
          select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
          from benchmark),
        windows as (
          select distinct item_id, least(10, len(w)) as size, array_to_string(w[pos : pos + least(10, len(w)) - 1], ' ') as phrase
          from test, unnest(range(1, greatest(1, len(w) - 9) + 1)) as t(pos) where len(w) > 0),
        sizes as (select distinct size from windows),
        places as (
          select doc_id, pos, size, array_to_string(w[pos : pos + size - 1], ' ') as phrase
          from lowered, sizes, unnest(range(1, len(w) - size + 2)) as t(pos)),
        occurs as (select doc_id, pos, size, item_id from places join windows using (size, phrase)),
        hit as (
          select doc_id, count(distinct word) as n_hit
          from occurs, unnest(range(pos, pos + size)) as t(word) group by doc_id),
        named as (
          select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
          from (select distinct doc_id, item_id from occurs where item_id is not null) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
        from lowered left join hit using (doc_id) left join named using (doc_id)""",
    # crc32 bit by bit, over the digits of conv_id
    "op11_prefix_trie": """
        with own as (
          select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text
          from conversations where conv_id is not null),
        convs as (
          select conv_id, conv_id - conv_id % 100 as base,
                 xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                   lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 6 as h
          from (select distinct conv_id from own)),
        mixed as (
          select c.conv_id, 0 as part, pos, role, text from convs c join own o on o.conv_id = base where pos <= h
          union all
          select conv_id, 1, pos, role, text from own join convs using (conv_id) where pos > h),
        paths as (
          select c.conv_id, coalesce(list({'r': role, 't': text} order by part, pos) filter (part is not null), []) as path
          from convs c left join mixed using (conv_id) group by c.conv_id),
        prefixes as (select conv_id, path[1:d] as path, d, len(path) as n from paths, unnest(range(len(path) + 1)) as t(d)),
        nodes as (
          select path, d::bigint as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(length(path[d].t), 0) as chars,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
          from prefixes group by path, d),
        linked as (
          select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and c.path[1 : n.depth] = n.path) as n_children
          from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1 : n.depth - 1]),
        sums as (
          select d.path, count(*) filter (n.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.chars)::bigint as saved_tokens
          from linked n, unnest(range(n.depth + 1)) as t(up), nodes d where d.depth = up and d.path = n.path[1:up] group by d.path)
        select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from linked join sums using (path)""",
    "op12_topk_search": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
          select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
          from v q join v c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select query_id, row_number() over w::int as rank, vec_id, score
        from scored window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 10""",
}
