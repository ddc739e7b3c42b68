"""Similarity self-join of documents on word n-grams, exact, by size-banded tiles and bitmap signatures.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Documents with the same set
make one class; only its smallest identifier goes on. The rest runs in three steps:

1. Sketch. Classes that share one of their few smallest hashes meet in a tile; each is compared with the
   smallest there, and with those whose bitmaps are nearest in its block of the tile. This joins most
   of a family of near copies by a few pairs for each member.
2. Tiles. In one global order (hashes that many documents hold come last) two sets of similarity t share
   an element among the first n - ceil(t n) + 1 of each. Each class puts these elements in tiles. Within a
   tile, classes of compatible size (bands) that are not in one component yet make candidate pairs. A large
   tile is compared in cells of two blocks. Where most members are in one component, which need no comparison
   with each other, only the others are copied to its blocks. Tiles of elements that very many documents hold
   are spread over tasks by member before anything is gathered.
3. Bounds, then proof. Every set has a bitmap of hashed elements. The bits that only one of two bitmaps
   has bound the overlap from above; pairs that may still reach t are intersected as sorted arrays.
   A coarse bitmap, which costs half to move, goes first.

Pairs inside a component are skipped meanwhile since they cannot change it. Both ends of a link lie in one
component, so the links are counted at the end: in each component every class is compared with every other,
by exact overlaps of blocks of sets. Counts, not pairs, leave a block. Each set is sent to as many cells as its
component has blocks, of LINK_BLOCK members: what is shuffled for the counts grows as the square of a component
over that, and the comparisons as the square; components themselves need neither.

Defined cases: null, empty and blank texts have an empty set, size 0, and are linked with nothing; a text
with fewer words than n has one element, its whole sequence; rows that repeat an identifier count as one
document with the smallest such set; each row with a null identifier is returned, with a null component.
one_of_each goes by rows instead: other texts under a repeated or null identifier are compared as well, and all
columns are returned as they are. An empty table gives no rows. A very long text is read whole by one task. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.components import components
from tidelode.llm.workspace import Workspace, release, row_keyed, sized

#: Smallest hashes of a set by which the sketch step compares it, members of a block there, and the
#: nearest others that each is paired with.
SKETCH, SKETCH_BLOCK, NEAREST = 4, 512, 2
#: Elements of a block in which local counts find frequent elements, and the count that reports one.
BLOCK, LOCAL = 1_000_000, 4
#: Elements reported that often in all go last in the global order; how many are kept (an order of any
#: kind gives the same result, so a shorter list costs time and loses nothing).
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Records of a tile file, and members up to which a tile lists its pairs at once.
TILE_RECORDS, PAIRED = 400_000, 16
#: Reports of an element from which on its tiles are spread over several files.
HOT = 50_000
#: Bits of a signature for each element, rounded up to a power of two, those of a coarse one, which already
#: tells unlike sets apart, and the fewest bits.
BITS_EACH, COARSE_EACH, FEWEST_BITS = 4, 2, 256

#: Members and elements of a block of a component whose links are counted, elements of the components that one
#: task counts together, and cells of the matrix in which overlaps are added up.
LINK_BLOCK, LINK_ELEMENTS, LINK_TOGETHER, LINK_CELLS = 1024, 1_000_000, 500_000, 4 << 20

_C = bt.splitmix(np.arange(5000, 5064, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(part: bt.Slice, n: int) -> Iterator[np.ndarray]:
    """For each row of a slice the sorted distinct hashes of its n-word shingles."""
    w = bt.words(part, bt.SPACED)
    rolled = np.zeros(0, np.uint64)
    if len(w.hashes) >= n:
        rolled = sum((w.hashes[k : len(w.hashes) - n + 1 + k] * _C[k] for k in range(n)), np.zeros(1, np.uint64))
        rolled = bt.splitmix(rolled)
    for lo, hi in zip(w.rows[:-1], w.rows[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(rolled[lo : hi - n + 1])
        elif hi > lo:
            yield bt.splitmix((w.hashes[lo:hi] * _C[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for part in bt.slices(bt.column(batch, "text")):
            yield from zip(ids[part.lo : part.hi], shingle_sets(part, n), strict=True)


# ---- step 0: sizes, digests, sketches and frequent elements, in one pass over the texts

_SEEN = "id bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>, element bigint, hits bigint"


def _seen(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("element", pa.int64()), ("hits", pa.int64())])
        rows: list[tuple] = []
        block: list[np.ndarray] = []
        digests: set[bytes] = set()
        held = 0

        def frequent() -> list[tuple]:
            found, hits = np.unique(np.concatenate(block), return_counts=True) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = hits >= LOCAL
            return [(None, None, None, None, None, int(e), int(h)) for e, h in zip(bt.signed(found[often]), hits[often], strict=True)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for i, s in _rows(batches, n):
            d = xxhash.xxh3_128_digest(s.tobytes())
            d1, d2 = np.frombuffer(d, np.int64).tolist()
            rows.append((i, len(s), d1, d2, bt.signed(s[:SKETCH]).tolist(), None, None))
            if d not in digests:  # copies in one block do not make their elements frequent
                digests.add(d)
                block.append(s)
                held += len(s)
            if held >= BLOCK:
                rows += frequent()
                block, held, digests = [], 0, set()
            if len(rows) >= 5000:
                yield out(rows)
                rows = []
        if rows := rows + frequent():
            yield out(rows)

    return run


def _digested(n: int):
    """Rows with the digest of their set, for tables that repeat identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bt.slices(bt.column(batch, "text")):
                rows = batch.slice(part.lo, part.hi - part.lo)
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(part, n)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text").cast(pa.binary()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["id", "text", "d1", "d2"])

    return run


# ---- signatures and sets of the classes that are in candidate pairs


def signature(s: np.ndarray, each: int = BITS_EACH) -> bytes:
    """A bitmap with the bit of each element's hash set, its width following the size of the set."""
    width = max(FEWEST_BITS, 1 << int(each * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps narrowed to width bytes: halves are laid over each other, as hashing does."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def _features(n: int, whole: bool):
    """Of each text its signature and a coarse one, or its whole set (and nothing coarse)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, coarse, held = [], [], [], 0
        out = lambda: pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "bits": pa.array(bits, pa.binary()), "coarse": pa.array(coarse, pa.binary())})
        for i, s in _rows(batches, n):
            ids.append(i)
            bits.append(s.tobytes() if whole else signature(s))
            coarse.append(None if whole else signature(s, COARSE_EACH))
            held += len(bits[-1])
            if held > 8 << 20:
                yield out()
                ids, bits, coarse, held = [], [], [], 0
        if ids:
            yield out()

    return run


def ones(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of a uint8 matrix, whose rows are whole 64-bit words."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint64)).sum(axis=1, dtype=np.int64)


def may_reach(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound on the overlap of each pair still allows the similarity.

    Every bit that only a's bitmap has stands for at least one element that b lacks, so the overlap is at
    most na less the number of such bits, and likewise for b.
    """
    most = np.minimum(na - ones(sa & ~sb), nb - ones(sb & ~sa))
    return most * (100 + percent) >= percent * (na + nb)


def allowed(n: np.ndarray, sigs: list[np.ndarray], percent: int, differ: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of sets in rising order of size, with their bitmaps: each k, and the later sets that its bitmap
    allows with the bounds on their overlaps. differ picks, of k and places behind it, those to compare.

    Sizes of similar sets differ by a factor under two, so a set meets bitmaps as wide as its own or
    twice that, which are folded; wider ones never cost a narrow set's precision.
    """
    width = np.array([len(x) for x in sigs])
    for w in np.unique(width).tolist():
        lo, hi = np.searchsorted(width, [w, 2 * w + 1])
        bits = np.concatenate([folded(x[None, :], w) for x in sigs[lo:hi]])
        for k in range(lo, int(np.searchsorted(width, w, side="right"))):
            at = differ(k, np.arange(k + 1, min(hi, int(np.searchsorted(n, 100 * n[k] // percent, side="right")))))
            if len(at):
                most = np.minimum(n[at] - ones(bits[at - lo] & ~bits[k - lo]), n[k] - ones(bits[k - lo] & ~bits[at - lo]))
                ok = most * (100 + percent) >= percent * (n[at] + n[k])
                if ok.any():
                    yield k, at[ok], most[ok]


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            (da, oa), (db, ob) = bt.raw(b.column("sig_a")), bt.raw(b.column("sig_b"))
            la, lb = np.diff(oa), np.diff(ob)
            ok = np.zeros(b.num_rows, bool)
            for wa, wb in set(zip(la.tolist(), lb.tolist(), strict=True)):
                every = np.flatnonzero((la == wa) & (lb == wb))
                step = max(1, bt.SLICE_BYTES // (wa + wb))
                for at in (every[k : k + step] for k in range(0, len(every), step)):
                    sa = folded(da[oa[at][:, None] + np.arange(wa)], min(wa, wb))
                    sb = folded(db[ob[at][:, None] + np.arange(wb)], min(wa, wb))
                    ok[at] = may_reach(sa, sb, na[at], nb[at], percent)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return run


def _proved(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            last, own = None, None
            for i, a, x, y in zip(range(b.num_rows), b.column("a").to_pylist(), b.column("set_a"), b.column("set_b"), strict=True):
                if a != last:
                    last, own = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (own, other) if len(own) <= len(other) else (other, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(own) + len(other) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


# ---- tiles


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n, first in the global order, of which similar sets share one."""
    return n - -(-percent * n // 100) + 1


_BANDS = 1.0 / np.log(4 / 3)
_FIELDS = (("tile", np.uint64), ("id", np.int64), ("root", np.int64), ("n", np.int64))


def _pack(rec: dict[str, np.ndarray]) -> bytes:
    """Columns after one another, ids as steps and roots as distances, compressed."""
    steps = np.diff(rec["id"], prepend=0)
    body = b"".join(x.tobytes() for x in (rec["tile"], steps, rec["root"] - rec["id"], rec["n"].astype(np.int64)))
    return len(rec["tile"]).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> dict[str, np.ndarray]:
    m = int.from_bytes(packed[:8], "little")
    body = pa.decompress(packed[8:], decompressed_size=32 * m, codec="zstd", asbytes=True)
    rec = {name: np.frombuffer(body, kind, m, 8 * m * k) for k, (name, kind) in enumerate(_FIELDS)}
    rec["id"] = np.cumsum(rec["id"])
    rec["root"] = rec["root"] + rec["id"]
    return rec


def _records(n: int, percent: int, frequent: np.ndarray, shift: int, hot: np.ndarray, spread: int):
    """Each class's prefix elements, packed for each file of tiles: (file, payload).

    Files from 1 << shift on hold the tiles of hot elements (a mask over frequent ones), by member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int, int, np.ndarray]] = []
        total = 0

        def out() -> pa.RecordBatch:
            long = [len(x[0]) for x in held]
            rec = {"tile": np.concatenate([x[0] for x in held])} | {name: np.repeat(np.array([x[k] for x in held], np.int64), long) for k, name in ((1, "id"), (2, "root"), (3, "n"))}
            file = (rec["tile"] >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(rec["tile"]), np.int64)
            often = np.concatenate([x[4] for x in held])
            if often.any():
                file[often] = (1 << shift) + (bt.splitmix(rec["id"][often].view(np.uint64) ^ rec["tile"][often]) % np.uint64(spread)).astype(np.int64)
            order = np.argsort(file, kind="stable")
            file = file[order]
            cut = np.flatnonzero(np.diff(file, prepend=-1))
            ends = np.append(cut[1:], len(file))
            packed = [_pack({k: v[order[lo:hi]] for k, v in rec.items()}) for lo, hi in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_pydict({"file": pa.array(file[cut]), "payload": pa.array(packed, pa.binary())})

        for batch in batches:
            ids, roots = batch.column("id").to_pylist(), batch.column("root").to_pylist()
            for part in bt.slices(bt.column(batch, "text")):
                for i, root, s in zip(ids[part.lo : part.hi], roots[part.lo : part.hi], shingle_sets(part, n), strict=True):
                    if len(s):
                        tiles, often = tiles_of(s, percent, frequent, hot)
                        held.append((tiles, i, root, len(s), often))
                        total += len(tiles)
                if total >= TILE_RECORDS:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    return run


def tiles_of(s: np.ndarray, percent: int, frequent: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tiles of a sorted set, and whether they are of hot elements: one for each rare element of its
    prefix, two for each frequent one.

    Tiles of frequent elements are split by size band: a set enters that of its own band and the next
    one, so two sets of compatible sizes still meet.
    """
    k = prefix_length(len(s), percent)
    if not len(frequent):
        return bt.splitmix(s[:k]), np.zeros(k, bool)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often][:k]
    if len(rare) == k:
        return bt.splitmix(rare), np.zeros(k, bool)
    band = np.array([[0], [1]], np.uint64) + np.uint64(int(np.log(len(s)) * _BANDS) + 1)
    common = s[often][: k - len(rare)]
    spread = np.concatenate([np.zeros(len(rare), bool), np.tile(hot[at[often][: k - len(rare)]], 2)])
    return np.concatenate([bt.splitmix(rare), bt.splitmix(common + band * _C[:1]).ravel()]), spread


_TILED = "a bigint, b bigint, na bigint, nb bigint, tile bigint, root bigint, lead boolean, block int, leads int, rests int, several boolean, members bigint"
#: Members of a large tile that are compared with each other by one task, and members from which on they are
#: compared by their finer bitmaps: such tiles hold families, whose pairs recur in many tiles.
CELL, FINE = 2048, 32


def led(tile: np.ndarray, root: np.ndarray) -> dict[str, np.ndarray]:
    """Of members sorted by tile: whether they are in the component that holds most of their tile's members, if
    it holds more than half of them; their block among such members, or among the others; the number of blocks
    of either kind; whether the others are of several components."""
    n = len(tile)
    order = np.lexsort((root, tile))
    t, r = tile[order], root[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1]))) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    same = np.repeat(count, count)
    begins = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, n))
    which = np.repeat(np.arange(len(begins)), size)
    lead = np.zeros(n, bool)
    lead[order] = 2 * same > size[which]
    tile_of = np.zeros(n, np.int64)
    tile_of[order] = which
    leads = np.bincount(tile_of, lead, len(begins)).astype(np.int64)
    rests = size - leads
    # rests of one component have as many members of one root as there are rests
    one = np.zeros(len(begins), bool)
    one[which[(same == rests[which]) & ~lead[order]]] = True
    both = tile_of * 2 + lead
    place = np.zeros(n, np.int64)
    by = np.argsort(both, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], both[by][1:] != both[by][:-1]))) if n else np.zeros(0, np.int64)
    place[by] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    return {"lead": lead, "block": place // CELL, "leads": (-(-leads // CELL))[tile_of], "rests": (-(-rests // CELL))[tile_of], "several": ~one[tile_of] & (rests[tile_of] > 1)}


def _tiled(percent: int, shift: int):
    """Pairs of small tiles, and the members (b null) of large ones, of classes in several components.

    Members of hot tiles come without anything about their tile, which other tasks hold too (members null).
    """

    def hot(rec: dict[str, np.ndarray]) -> pa.Table:
        n = len(rec["tile"])
        none = lambda kind: pa.nulls(n, kind)
        own = {"a": rec["id"], "na": rec["n"], "tile": bt.signed(rec["tile"].copy()), "root": rec["root"]}
        kinds = {"b": pa.int64(), "nb": pa.int64(), "lead": pa.bool_(), "block": pa.int32(), "leads": pa.int32(), "rests": pa.int32(), "several": pa.bool_(), "members": pa.int64()}
        return pa.table({c: pa.array(own[c]) if c in own else none(kinds[c]) for c in ("a", "b", "na", "nb", "tile", "root", "lead", "block", "leads", "rests", "several", "members")})

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in table.column("payload")]
        rec = {k: np.concatenate([x[k] for x in parts]) for k, _ in _FIELDS}
        if table.column("file")[0].as_py() >= 1 << shift:
            return hot(rec)

        def pick(at: np.ndarray) -> None:
            for k in rec:
                rec[k] = rec[k][at]

        pick(np.argsort(rec["tile"], kind="stable"))
        first = np.flatnonzero(np.diff(rec["tile"], prepend=rec["tile"][:1] ^ np.uint64(1))) if len(rec["tile"]) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(rec["tile"])))
        several = np.minimum.reduceat(rec["root"], first) != np.maximum.reduceat(rec["root"], first) if len(first) else np.zeros(0, bool)
        member = np.repeat(several, size)
        pick(member)
        size = np.repeat(size[several], size[several])
        order = np.lexsort((rec["id"], rec["n"], rec["tile"]))
        pick(order)  # tiles stay in their order, so size needs no change
        t, i, r, n = (rec[k] for k, _ in _FIELDS)
        small = size <= PAIRED
        found = []
        for lag in range(1, PAIRED):
            ok = small[:-lag] & (t[:-lag] == t[lag:]) & (r[:-lag] != r[lag:]) & (100 * n[:-lag] >= percent * n[lag:])
            if ok.any():
                found.append(np.stack([i[:-lag][ok], i[lag:][ok], n[:-lag][ok], n[lag:][ok]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        swap = pairs[0] > pairs[1]
        pairs[:, swap] = pairs[[1, 0, 3, 2]][:, swap]
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs
        big = np.flatnonzero(~small)
        about = led(t[big], r[big])
        p, q = pairs.shape[1], len(big)
        of = lambda name, kind: pa.concat_arrays([pa.nulls(p, kind), pa.array(about[name], kind)])
        return pa.table({
            "a": pa.array(np.concatenate([pairs[0], i[big]])), "b": pa.concat_arrays([pa.array(pairs[1]), pa.nulls(q, pa.int64())]),
            "na": pa.array(np.concatenate([pairs[2], n[big]])), "nb": pa.concat_arrays([pa.array(pairs[3]), pa.nulls(q, pa.int64())]),
            "tile": pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(bt.signed(t[big].copy()))]), "root": pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(r[big])]),
            "lead": of("lead", pa.bool_()), "block": of("block", pa.int32()), "leads": of("leads", pa.int32()), "rests": of("rests", pa.int32()), "several": of("several", pa.bool_()), "members": pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(size[big])]),
        })

    return run


def _compared(percent: int):
    """The pairs of a cell, two blocks of a tile, whose bitmaps allow the similarity."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("na", "ascending"), ("a", "ascending")])
        i, n, root, block, lead = (table.column(k).to_numpy() for k in ("a", "na", "root", "block", "lead"))
        if table.column("mixed")[0].as_py():
            differ = lambda k, at: at[lead[at] != lead[k]]
        else:
            one = table.column("x")[0].as_py() == table.column("y")[0].as_py()
            differ = lambda k, at: at[(root[at] != root[k]) & ((block[at] != block[k]) | one)]
        sigs = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sig")]
        found = [np.stack([np.full(len(at), k), at]) for k, at, _ in allowed(n, sigs, percent, differ)]
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        x, y = np.where(i[x] < i[y], x, y), np.where(i[x] < i[y], y, x)
        return pa.table({"a": pa.array(i[x]), "b": pa.array(i[y]), "na": pa.array(n[x]), "nb": pa.array(n[y])})

    return run


def _nearest(percent: int):
    """For each class of a block of a sketch tile, the others of nearest bitmap that may be similar."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "ascending"), ("class", "ascending")])
        i, n, root = (table.column(k).to_numpy() for k in ("class", "n", "root"))
        sigs = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sig")]
        found = [np.stack([np.full(len(at), k), at, most]) for k, at, most in allowed(n, sigs, percent, lambda k, at: at[root[at] != root[k]])]
        x, y, most = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        own, other = np.concatenate((x, y)), np.concatenate((y, x))
        score = np.tile(most / np.maximum(n[x] + n[y] - most, 1), 2)
        order = np.lexsort((other, -score, own))
        own, other = own[order], other[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        pairs = np.sort(np.stack([i[own], i[other]])[:, rank < NEAREST], axis=0)
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return run


# ---- links inside components


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[rows] with sets[cols]."""
    size = np.array([len(x) for x in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(element) > 1
    owner, element = np.repeat(np.arange(len(sets)), size), element.ravel()
    keep = shared[element]
    owner, element = owner[keep], (np.cumsum(shared) - 1)[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    both = np.zeros((len(rows), len(cols)), np.int64)
    # float32 holds counts up to 2**24 exactly; steps are narrower by far
    step = max(1, LINK_CELLS // len(sets))
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(element, [lo, lo + step])
        held = np.zeros((len(sets), step), np.float32)
        held[owner[a:b], element[a:b] - lo] = 1
        both += (held[rows] @ held[cols].T).astype(np.int64)
    return both


def _linked(percent: int):
    """Of a cell, two blocks of a component or several small components: each class's links there, and
    the documents that they reach."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("root", "ascending"), ("class", "ascending")])
        root, i, n, copies, block = (table.column(k).to_numpy() for k in ("root", "class", "n", "copies", "block"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bits")]
        one = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        links, similar = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        cut = np.flatnonzero(np.diff(root, prepend=root[0] ^ 1))
        for lo, hi in zip(cut, np.append(cut[1:], len(i)), strict=True):
            at = np.arange(hi - lo)
            rows = at if one else np.flatnonzero(block[lo:hi] == table.column("x")[0].as_py())
            cols = at if one else np.setdiff1d(at, rows)
            if not (len(rows) and len(cols)):
                continue
            both = overlaps(sets[lo:hi], rows, cols)
            rows, cols = rows + lo, cols + lo
            ok = 100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)
            if one:
                np.fill_diagonal(ok, False)
            links[rows] += ok.sum(axis=1)
            similar[rows] += ok @ copies[cols]
            if not one:
                links[cols] += ok.sum(axis=0)
                similar[cols] += copies[rows] @ ok
        return pa.table({"class": pa.array(i), "n_links": pa.array(links), "n_similar": pa.array(similar)})

    return run


# ---- the join


class NgramJoin:
    """One run of the join over docs(id, text); see the module's text for its steps."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.spark, self.n, self.percent = spark, n, percent
        self.work = Workspace(spark, "ngram-join")
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        self.signatures: list[DataFrame] = []

    def _made(self, ids: DataFrame, whole: bool) -> DataFrame:
        """id and bits, the signature or the whole set, of written ids."""
        made = self.docs.join(sized(ids, 24), "id", "left_semi").mapInArrow(bt.lean(_features(self.n, whole)), "id bigint, bits binary, coarse binary")
        return made

    def _signed(self, ids: DataFrame, name: str) -> None:
        """Adds the signatures of those ids that have none yet."""
        for f in self.signatures:
            ids = ids.join(f.select("id"), "id", "left_anti")
        self.signatures.append(self.work.write(self._made(self.work.write(ids.distinct(), f"{name}-ids"), False), name))
        release(self.spark)

    def _sigs(self, key: str, value: str, kind: str = "bits") -> DataFrame:
        out = self.signatures[0]
        for f in self.signatures[1:]:
            out = out.unionByName(f)
        return out.select(F.col("id").alias(key), F.col(kind).alias(value))

    def _bounded(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b, na, nb) those that their bitmaps allow: first the coarse ones, then the others."""
        for kind in ("coarse", "bits"):
            both = pairs.join(self._sigs("a", "sig_a", kind), "a").join(self._sigs("b", "sig_b", kind), "b")
            pairs = self.work.write(both.mapInArrow(bt.lean(_bounded(self.percent)), "a bigint, b bigint, na bigint, nb bigint"), f"{name}-{kind}")
        return pairs

    def _proved(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) that bitmaps allow those that are similar. Only their sets are made and moved."""
        open_ = self.work.write(pairs.select("a", "b").distinct(), f"{name}-open")
        ids = self.work.write(open_.select(F.col("a").alias("id")).unionByName(open_.select(F.col("b").alias("id"))).distinct(), f"{name}-open-ids")
        sets = self.work.write(self._made(ids, True), f"{name}-sets")
        side = lambda k: sets.select(F.col("id").alias(k), F.col("bits").alias(f"set_{k}"))
        full = open_.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")
        links = self.work.write(full.mapInArrow(bt.lean(_proved(self.percent)), "a bigint, b bigint"), f"{name}-links")
        self.work.drop(f"{name}-sets")
        release(self.spark)
        return links

    def run(self) -> DataFrame:
        """Documents: id, n, root, class."""
        work, percent = self.work, self.percent
        seen = work.write(self.docs.mapInArrow(bt.lean(_seen(self.n)), _SEEN), "seen")
        rows = seen.where("n is not null").select("id", "n", "d1", "d2", "sketch")
        unique = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
        if not unique:
            # where an identifier repeats, its smallest set speaks for it, from here on by one such text
            smallest = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("n", "d1", "d2", "sketch")).alias("s")).select("id", "s.*")
            rows = work.write(smallest.unionByName(rows.where("id is null")), "rows")
            self.docs = work.write(self.docs.mapInArrow(bt.lean(_digested(self.n)), "id bigint, text binary, d1 bigint, d2 bigint").join(rows.select("id", "d1", "d2"), ["id", "d1", "d2"], "left_semi").dropDuplicates(["id"]).select("id", F.col("text").cast("string").alias("text")), "docs")
        classes = work.write(rows.where("id is not null and n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("class"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
        copies = work.write(rows.join(classes.where("copies > 1").select("n", "d1", "d2", "class"), ["n", "d1", "d2"]).where("id <> class").select("id", "class"), "copies")

        # sketch: each class of a tile with the smallest there and with its nearest ones
        tiles = classes.select("class", "n", F.explode("sketch").alias("element"))
        heads = tiles.groupBy("element").agg(F.min(F.struct("n", "class")).alias("head"), F.count("*").alias("m")).where("m > 1")
        tiles = work.write(tiles.join(heads, "element"), "sketch-tiles")
        near = (F.col("class") != F.col("head.class")) & (F.col("head.n") * 100 >= percent * F.col("n"))
        pair = F.array_sort(F.array(F.struct(F.col("class").alias("id"), "n"), F.struct(F.col("head.class").alias("id"), F.col("head.n").alias("n"))))
        star = work.write(tiles.where(near).select(pair.alias("p")).distinct().select(F.col("p")[0].id.alias("a"), F.col("p")[1].id.alias("b"), F.col("p")[0].n.alias("na"), F.col("p")[1].n.alias("nb")), "sketch-pairs")
        self._signed(tiles.select(F.col("class").alias("id")), "signatures-0")
        links = self._proved(self._bounded(star, "star"), "star")
        roots = work.write(components(links, work, "star-components"), "star-roots")
        block = F.pmod(F.xxhash64("class", "element"), F.ceil(F.col("m") / SKETCH_BLOCK))
        cells = tiles.join(self._sigs("class", "sig"), "class").join(sized(roots.withColumnRenamed("node", "class"), 40), "class", "left")
        cells = cells.select("element", block.alias("block"), "class", "n", F.coalesce("root", "class").alias("root"), "sig").groupBy("element", "block").applyInArrow(bt.lean_group(_nearest(percent)), "a bigint, b bigint")
        links = links.unionByName(self._proved(cells, "nearest"))
        roots = work.write(components(links, work, "sketch-components"), "sketch-roots")

        # tiles of the exact prefix filter
        often = seen.where("element is not null").groupBy("element").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= FREQUENT)
        often = work.write(often.orderBy(F.desc("hits"), "element").limit(MOST_FREQUENT).select("element", "hits"), "frequent").toArrow()
        frequent, hits = often.column("element").to_numpy().astype(np.int64).view(np.uint64), often.column("hits").to_numpy()
        order = np.argsort(frequent)
        frequent, hot = frequent[order], hits[order] >= HOT
        spread = max(1, int(-(-int(hits[hits >= HOT].sum()) // TILE_RECORDS)))
        total = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).head()[0] or 0
        shift = max(0, int(np.ceil(np.log2(max(1.0, total / TILE_RECORDS)))))
        texts = self.docs.where("id is not null").join(sized(copies.select("id"), 24), "id", "left_anti").join(sized(roots.select(F.col("node").alias("id"), "root"), 40), "id", "left").select("id", "text", F.coalesce("root", "id").alias("root"))
        packed = texts.mapInArrow(bt.lean(_records(self.n, percent, frequent, shift, hot, spread)), "file bigint, payload binary")
        tiled = work.write(packed.groupBy("file").applyInArrow(bt.lean_group(_tiled(percent, shift)), _TILED), "tiled")
        small = tiled.where("b is not null").select("a", "b", "na", "nb")
        large = tiled.where("b is null and members is not null")
        if hot.any():
            large = large.unionByName(self._hot(tiled.where("b is null and members is null").select("a", "na", "tile", "root")), allowMissingColumns=True)
        ids = tiled.select(F.col("a").alias("id")).unionByName(small.select(F.col("b").alias("id")))
        self._signed(ids, "signatures-1")
        # cells of a block of the leading component and one of the others, and of two blocks of the others
        cell_of = lambda mixed, x, y: F.struct(F.lit(mixed).alias("mixed"), x.alias("x"), y.alias("y"))
        up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        block, leads, rests = F.col("block"), F.col("leads"), F.col("rests")
        own = F.transform(up_to(rests), lambda k: cell_of(True, block, k))
        others = F.transform(up_to(leads), lambda k: cell_of(True, k, block))
        others = F.concat(others, F.when(F.col("several"), F.transform(up_to(rests), lambda k: cell_of(False, F.least(k, block), F.greatest(k, block)))).otherwise(F.array().cast("array<struct<mixed:boolean,x:int,y:int>>")))
        cell = F.explode(F.when(F.col("lead"), own).otherwise(others))
        fine = large.where(F.col("members") >= FINE).join(self._sigs("a", "sig"), "a")
        cells = large.where(F.col("members") < FINE).join(self._sigs("a", "sig", "coarse"), "a").unionByName(fine).withColumn("cell", cell).select("tile", "cell.mixed", "cell.x", "cell.y", "a", "na", "root", "lead", "block", "sig")
        cells = cells.groupBy("tile", "mixed", "x", "y").applyInArrow(bt.lean_group(_compared(percent)), "a bigint, b bigint, na bigint, nb bigint")
        more = self._proved(self._bounded(small.unionByName(cells).distinct(), "tile"), "tile")
        links = links.unionByName(more)
        whole = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = work.write(components(whole, work, "components"), "roots")

        # back to documents: copies to their class, classes to their root, empty sets to themselves
        named = rows.join(sized(copies, 40), "id", "left").withColumn("class", F.coalesce("class", "id"))
        named = named.join(sized(roots.withColumnRenamed("node", "class"), 40), "class", "left").select("id", "n", F.coalesce("root", "class").alias("root"), "class")
        self.classes, self.roots = classes, roots
        return named

    def _hot(self, members: DataFrame) -> DataFrame:
        """Members of hot tiles with what `led` tells of a tile, by counts that are summed before each shuffle."""
        each = self.work.write(members.groupBy("tile", "root").agg(F.count("*").alias("c")), "hot-roots")
        tiles = each.groupBy("tile").agg(F.sum("c").alias("members"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        led_ = F.col("most.c") * 2 > F.col("members")
        lead = F.when(led_, F.col("most.c")).otherwise(F.lit(0))
        count = lambda c: F.ceil(c / CELL).cast("int")
        tiles = self.work.write(tiles.select("tile", F.when(led_, F.col("most.root")).alias("top"), count(lead).alias("leads"), count(F.col("members") - lead).alias("rests"), ((F.col("roots") - led_.cast("int")) > 1).alias("several"), "members"), "hot-tiles")
        rows = members.join(sized(tiles, 48), "tile").withColumn("lead", F.coalesce(F.col("root") == F.col("top"), F.lit(False)))
        return rows.withColumn("block", F.pmod(F.xxhash64("a", "tile"), F.when(F.col("lead"), F.col("leads")).otherwise(F.col("rests"))).cast("int")).drop("top")

    def degrees(self) -> DataFrame:
        """After run(), of each class with links: class, n_links (to other classes), n_similar (documents of these)."""
        work = self.work
        members = work.write(self.roots.withColumnRenamed("node", "class").join(self.classes.select("class", "n", "copies"), "class"), "members")
        groups = work.write(members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("elements"), F.sum("copies").alias("docs")), "groups")
        # the two classes of a component of two are linked, or it would not be one
        two = members.join(groups.where("m = 2"), "root").select("class", F.lit(1).cast("bigint").alias("n_links"), (F.col("docs") - F.col("copies")).alias("n_similar"))
        blocks = F.greatest(F.ceil(F.col("m") / LINK_BLOCK), F.ceil(F.col("elements") / LINK_ELEMENTS)).cast("int")
        wanted = members.join(groups.where("m > 2").select("root", blocks.alias("blocks")), "root")
        wanted = work.write(wanted.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "link-members")
        together = max(1, (wanted.where("blocks = 1").agg(F.sum("n")).head()[0] or 0) // LINK_TOGETHER)
        key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(together))).otherwise(F.col("root"))
        sets = work.write(self._made(work.write(wanted.select(F.col("class").alias("id")), "link-ids"), True).select(F.col("id").alias("class"), "bits"), "link-sets")
        cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y"))))
        cells = wanted.join(sets, "class").select(key.alias("key"), cell.alias("cell"), "root", "class", "n", "copies", "block", "bits")
        cells = cells.select("key", "cell.x", "cell.y", "root", "class", "n", "copies", "block", "bits").groupBy("key", "x", "y")
        found = work.write(cells.applyInArrow(bt.lean_group(_linked(self.percent)), "class bigint, n_links bigint, n_similar bigint"), "linked")
        work.drop("link-sets")
        return found.groupBy("class").agg(F.sum("n_links").alias("n_links"), F.sum("n_similar").alias("n_similar")).unionByName(two)


def ngram_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, class_id, n_links, n_similar.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles.
    component_id is the smallest identifier that links reach, class_id the smallest with the same set,
    n_links the number of other sets (classes) that link with the document's, n_similar the number of other
    documents that link with it, those of the same set included.
    """
    join = NgramJoin(spark, docs, id_col, text_col, n, percent)
    named = join.run()
    degree = join.classes.select("class", "copies").join(join.degrees(), "class", "left")
    degree = degree.select("class", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("n_similar", F.lit(0)) + F.col("copies") - 1).alias("n_similar"))
    named = named.join(degree, "class", "left")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without those that another of their component, with a smaller doc_id, stands for.

    Where doc_ids repeat or are null each row counts by itself; of equal ids one row stands for the others,
    and null ids come last.
    """
    work = Workspace(spark, "ngram-join-kept")
    rows, key = row_keyed(docs, work)
    gone = work.write(NgramJoin(spark, rows, key, "text", 5, 75).run().where("id <> root").select(F.col("id").alias(key)), "gone")
    return rows.join(sized(gone, 24), key, "left_anti").select(*docs.columns)
