"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one per dimension.

Vectors are dealt by a hash of their row to blocks of a bounded number of components, and each block keeps, for
every dimension, the places of its vectors in rising order of that component. A query meets each block once. It
reads all lists from their better ends (the upper one where its own component is positive, the lower one where it
is negative), to a depth that doubles, and scores each vector as soon as any list shows it. A vector that no list
has shown yet can score at most the sum of the query's components times the last values read; when that bound is
below the k-th score found, the rest of the block is left unread.

A query goes to one block first. The k-th score that it finds there is a floor for all other blocks, which stop
and report accordingly; what the blocks report is cut to k rows a query before it is shuffled.

Components are floor(SCALE * x) as integers and scores exact: sums of doubles where they stay below 2**53, else
Python's integers, held to the range of a long in the result.

Defined cases: rows with a null identifier or vector, or a null, NaN or infinite component (after scaling too),
take no part. Vectors meet those of their own length only; vectors of no components all score 0. Ties go to the
smaller identifier, then to the row read first. A repeated identifier is several rows: each is found and searched
for by itself, and only its own row is left out. Fewer candidates than k are all returned; an empty table gives
no rows. Very long vectors make blocks of fewer rows, one at least. Other columns are not read. Texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.workspace import Workspace, sized

#: Components are floor(SCALE * x).
SCALE = 1024
#: Components in a block of vectors, and in one of queries; entries of each list read in the first round.
BLOCK_CELLS, QUERY_CELLS, FIRST_DEPTH = 1 << 19, 1 << 16, 8
#: Sums below this are exact as doubles.
_EXACT = float(1 << 53)


def rows_per_block(size: int, cells: int) -> int:
    return max(1, cells // max(1, size))


class Block:
    """Vectors with the sorted list of each of their dimensions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.rows = ids, rows
        self.values = values  # vectors x dimensions, whole numbers as doubles
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        self.most = float(np.abs(values).max(initial=0.0))

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """Up to k best (score, id, row) that reach the floor, without row `own`, and how many vectors were scored."""
        n, size = self.values.shape
        values, lists = self.values, self.sorted
        if float(np.abs(query).max(initial=0.0)) * self.most * max(1, size) >= _EXACT:
            whole = np.vectorize(int, otypes=[object])
            values, lists, query = whole(values), whole(lists), whole(query)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, marked = np.zeros(n, bool), np.zeros(n, bool)
        scores, places = np.zeros(0, query.dtype), np.zeros(0, np.int64)
        begin, end = 0, min(n, FIRST_DEPTH)
        while True:
            if len(up) or len(down):
                marked[self.order[up, n - end : n - begin]] = True
                marked[self.order[down, begin:end]] = True
            else:
                marked[:] = True  # all score 0
            new = np.flatnonzero(marked & ~seen)
            seen[new] = True
            new = new[self.rows[new] != own]
            if len(new):
                scores = np.concatenate([scores, values[new] @ query])
                places = np.concatenate([places, new])
                best = np.lexsort((self.rows[places], self.ids[places], -scores))[:k] if len(places) <= 4 * k else self._first(scores, places, k)
                scores, places = scores[best], places[best]
            if end == n or seen.all():
                break
            bound = (query[up] @ lists[up, n - end] if len(up) else 0) + (query[down] @ lists[down, end - 1] if len(down) else 0)
            kth = scores[-1] if len(scores) == k else None
            if (kth is not None and bound < kth) or (floor is not None and bound < floor):
                break
            begin, end = end, min(n, 2 * end)
        found = [(int(s), int(self.ids[p]), int(self.rows[p])) for s, p in zip(scores, places, strict=True)]
        return [x for x in found if floor is None or x[0] >= floor], int(seen.sum())

    def _first(self, scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """The k best in order, without sorting all."""
        some = np.flatnonzero(scores >= (np.partition(scores, len(scores) - k)[len(scores) - k]))
        return some[np.lexsort((self.rows[places[some]], self.ids[places[some]], -scores[some]))[:k]]


def _matrix(col: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in col.chunks]) if col.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(-1, size) if size else np.zeros((len(col), 0))


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block of vectors: the content of a Block."""
    size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
    rows = np.asarray(table.column("row"), np.int64)
    by = np.argsort(rows, kind="stable")
    b = Block(np.asarray(table.column("vec_id"), np.int64)[by], rows[by], np.floor(SCALE * _matrix(table.column("x"), size))[by])
    kind = np.int16 if b.most < 1 << 15 else np.float64
    cells = [b.ids.tobytes(), b.rows.tobytes(), np.dtype(kind).str, b.values.astype(kind).tobytes(), b.order.tobytes()]
    return pa.table([[size], [block], *([c] for c in cells)], schema=pa.schema([("size", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("kind", pa.string()), ("cells", pa.binary()), ("places", pa.binary())]))


_PACKED = "size int, block bigint, ids binary, rows binary, kind string, cells binary, places binary"


def _unpacked(table: pa.Table, k: int) -> Block:
    get = lambda name: table.column(name)[k].as_py()
    ids, size = np.frombuffer(get("ids"), np.int64), get("size")
    values = np.frombuffer(get("cells"), np.dtype(get("kind"))).astype(np.float64).reshape(len(ids), size)
    return Block(ids, np.frombuffer(get("rows"), np.int64), values, np.frombuffer(get("places"), np.int32).reshape(size, len(ids)))


def _searched(k: int):
    kinds = {"q_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "c_row": pa.int64(), "score": pa.int64()}

    def run(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for at in range(len(blocks) if len(queries) else 0):
            block = _unpacked(blocks, at)
            vectors = np.floor(SCALE * _matrix(queries.column("x"), block.values.shape[1]))
            floors = queries.column("floor").to_pylist()
            for q, row, own, floor in zip(vectors, queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), floors, strict=True):
                found, _ = block.top(q, row, k, floor)
                out += [(row, own, i, r, max(-(1 << 63), min((1 << 63) - 1, s))) for s, i, r in found]
        bt.trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds.values(), strict=True)], names=list(kinds))

    return run


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x, size) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).withColumn("size", F.size("x"))


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors of each query, which is a row of the same table.

    is_query is a condition on vec_id. Blocks of vectors and queries meet by key, so each task holds one of each.
    """
    work = Workspace(spark, "top-k")
    rows = work.write(taking_part(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "rows")
    per = lambda cells: F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(F.lit(1), F.col("size"))))
    sizes = work.write(
        rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
        .select("size", F.ceil(F.col("n") / per(BLOCK_CELLS)).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("q") / per(QUERY_CELLS))).alias("lanes")),
        "sizes",
    )
    dealt = rows.join(sized(sizes, 32), "size")
    blocks = work.write(dealt.withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).groupBy("size", "block").applyInArrow(bt.lean_group(_packed), _PACKED), "blocks")
    asked = dealt.where(is_query).withColumn("lane", F.pmod(F.xxhash64(F.lit(1), "row"), "lanes")).withColumn("first", F.pmod(F.xxhash64(F.lit(2), "row"), "blocks"))
    lists = blocks.join(sized(sizes, 32), "size").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lanes") - 1)))

    def met(queries: DataFrame) -> DataFrame:
        key = ["size", "block", "lane"]
        left = queries.select(*key, "row", "vec_id", "x", "floor").groupBy(*key)
        return left.cogroup(lists.groupBy(*key)).applyInArrow(_searched(k), "q_row bigint, query_id bigint, vec_id bigint, c_row bigint, score bigint")

    first = work.write(met(asked.withColumns({"block": F.col("first"), "floor": F.lit(None).cast("bigint")})), "first")
    floors = first.groupBy("q_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = asked.join(floors, asked["row"] == floors["q_row"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("block <> first")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    ranked = first.unionByName(met(rest)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
