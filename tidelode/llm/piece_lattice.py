"""Segmentation into the pieces of a SentencePiece model: best and N-best encodings, and decoding.

A text becomes a space and its bytes, as the model's dummy prefix asks. No piece has a space behind
another character, and control characters are in no piece, so the lattice of a text falls apart into
units: a run of spaces with the characters behind it, or one such control character. The best paths of
all distinct units of a slice are found together: forward Viterbi scores by numpy over a matrix of units.

N-best lists of a unit come from a backward A* search over its lattice, whose heuristic is the forward
Viterbi score of the place reached. That is the exact cost of the rest, so the search never opens a path
that is not a prefix of one of the N best. In the N best of a text only the N - 1 units with the smallest
loss to their second path can differ from the best one; their lists are merged by a heap.

A long unit (a text in a script without spaces, a blob) would fill the search's agenda with millions of open
paths. There the same search runs by iterative deepening: a depth-first walk from the end takes only edges
whose loss against the forward scores stays within a bound, so it never meets a dead end and holds one path;
the bound then rises to the least loss that it turned away. Memory is a few dozen bytes for each byte of the unit.

A path's score is the sum of the pieces' scores; of equal scores the path with the longer last piece (then
the one in front of it, and so on) is first. A character that is no piece costs less than any piece and
gives the byte pieces of its UTF-8. The character U+2581, which stands for a space inside models, is
written by bytes too, so that decoding returns every text exactly.

Defined cases: null and empty texts have no tokens and one empty path; a text with fewer than N paths
gives all it has; rows that repeat, and repeated or null identifiers, are each returned; an empty table gives
no rows; a very long text is held whole by one task, with arrays of a bounded number of bytes for each of its own.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt
from tidelode.llm.workspace import Workspace

#: Paths of a text that a query returns, bytes of a slice, longest unit of a matrix, units of a matrix.
N_BEST, SLICE, LONGEST, MATRIX = 4, 1 << 20, 64, 4096
#: Units whose N-best lists a task remembers.
REMEMBER = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = -1e18
#: Scores below this mark pieces that the model does not use by itself.
_UNUSED = -1e8
#: Losses that differ by less are equal.
_SAME = 1e-9


class Pieces:
    """The vocabulary as bytes, with spaces for U+2581, and tables to look up parts of units by hash."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.bytes_ = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace("▁", " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.byte_id = np.full(256, -1)
        normal: dict[bytes, int] = {}
        for i, (b, k) in enumerate(zip(self.bytes_, kinds, strict=True)):
            if k == "byte":
                self.byte_id[b[0]] = i
            elif k == "normal" and scores[i] > _UNUSED:
                normal.setdefault(b, i)
        self.ids, self.scores = normal, np.array(scores, np.float64)
        self.unknown = min(scores[i] for i in normal.values()) - 10
        used = np.zeros(256, bool)
        used[list({x for b in normal for x in b})] = True
        self.cut = ~used & (np.arange(256) < 0x80)
        self.longest = max(map(len, normal))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for long in sorted({len(b) for b in normal}):
            own = [(b, i) for b, i in normal.items() if len(b) == long]
            h = _prefix_hash(np.array([list(b) for b, _ in own], np.uint8))[:, -1]
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.tables[long] = h[order], np.array([i for _, i in own])[order], seen
        self.size = np.array([len(b) for b in self.bytes_])
        self.begin = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(self.bytes_), np.uint8)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a model file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)])


def _prefix_hash(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... bytes of each row."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    keys = bt.BYTE_KEY[rows]
    for k in range(rows.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + keys[:, k]
    return out


_LEAD = np.zeros(256, np.int64)  # bytes of a character by its first byte; 0 inside of one
_LEAD[:0x80], _LEAD[0xC0:0xE0], _LEAD[0xE0:0xF0], _LEAD[0xF0:] = 1, 2, 3, 4


class Lattice:
    """Units of one length as rows of a matrix: scores of all edges, and forward and backward Viterbi."""

    def __init__(self, pieces: Pieces, rows: np.ndarray):
        self.pieces, (self.n, self.long) = pieces, rows.shape
        n, long = rows.shape
        self.rows = rows
        h = _prefix_hash(rows)
        power = np.ones(1, np.uint64)
        self.edge: dict[int, np.ndarray] = {}  # piece by length and start, -1 for none
        for k in range(1, min(long, pieces.longest) + 1):
            power = power * _BASE
            if k not in pieces.tables:
                continue
            hashes, ids, seen = pieces.tables[k]
            part = h[:, k:] - h[:, : long - k + 1] * power
            found = np.full(part.shape, -1, np.int32)
            r, c = np.nonzero(seen[(part >> np.uint64(48)).astype(np.int64)])
            value = part[r, c]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            ok = hashes[at] == value
            found[r[ok], c[ok]] = ids[at[ok]]
            if ok.any():
                self.edge[k] = found
        self.raw = np.zeros((n, long), bool)  # characters written by their bytes
        lead = _LEAD[rows]
        for k in range(1, 5):
            if long >= k:
                own = lead[:, : long - k + 1] == k
                if k in self.edge:
                    own &= self.edge[k] < 0
                self.raw[:, : long - k + 1] |= own
        for k in range(1, 5):
            if (self.raw & (lead == k)).any() and k not in self.edge:
                self.edge[k] = np.full((n, long - k + 1), -1, np.int32)
        self.value: dict[int, np.ndarray] = {}
        for k, ids in self.edge.items():
            unknown = self.raw[:, : long - k + 1] & (lead[:, : long - k + 1] == k)
            self.value[k] = np.where(ids >= 0, pieces.scores[ids], np.where(unknown, pieces.unknown, _NEVER))
        self.forward = np.full((n, long + 1), _NEVER)
        self.forward[:, 0] = 0
        self.last = np.zeros((n, long + 1), np.int16)
        lengths = sorted(self.value, reverse=True)
        for j in range(1, long + 1):
            best, step = self.forward[:, j], self.last[:, j]
            for k in lengths:
                if k <= j:
                    score = self.forward[:, j - k] + self.value[k][:, j - k]
                    better = score > best
                    best[better], step[better] = score[better], k

    def losses(self) -> np.ndarray:
        """What the second-best path of each unit costs against the best; infinite for a single path.

        The second path has an edge that the best has not; the best path through such an edge is known
        from the scores in front of it and behind it.
        """
        n, long = self.n, self.long
        back = np.full((n, long + 1), _NEVER)
        back[:, long] = 0
        for i in range(long - 1, -1, -1):
            for k, v in self.value.items():
                if i + k <= long:
                    np.maximum(back[:, i], v[:, i] + back[:, i + k], out=back[:, i])
        on = np.zeros((n, long + 1), np.int16)  # length of the best path's edge that ends there
        place = np.full(n, long)
        every = np.arange(n)
        while (place > 0).any():
            step = self.last[every, place]
            on[every, place] = step
            place = place - step
        second = np.full(n, _NEVER)
        for k, v in self.value.items():
            through = self.forward[:, : long - k + 1] + v + back[:, k:]
            through[on[:, k:] == k] = _NEVER
            np.maximum(second, through.max(axis=1), out=second)
        return np.where(second > _NEVER / 2, self.forward[:, long] - second, np.inf)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths, unit after unit, and how many each has."""
        n = self.n
        every, place = np.arange(n), np.full(n, self.long)
        out, rank = [], []
        count = np.zeros(n, np.int64)
        while (live := place > 0).any():
            r = every[live]
            step = self.last[r, place[live]].astype(np.int64)
            start = place[live] - step
            ids = np.full(len(r), -1, np.int64)
            for k in np.unique(step):
                at = step == k
                ids[at] = self.edge[int(k)][r[at], start[at]]
            known = ids >= 0
            out.append(np.stack([r[known], ids[known], count[r[known]]]))
            count[r[known]] += 1
            for d in range(4):  # bytes of other characters, from the last
                more = ~known & (step > d)
                rr = r[more]
                out.append(np.stack([rr, self.pieces.byte_id[self.rows[rr, (start + step)[more] - 1 - d]], count[rr]]))
                count[rr] += 1
            place[live] = start
        unit, ids, order = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        begin = np.cumsum(count) - count
        flat = np.empty(len(ids), np.int64)
        flat[begin[unit] + count[unit] - 1 - order] = ids
        return flat, count


def n_best(pieces: Pieces, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best paths of a unit with their scores, by backward A* under forward Viterbi scores."""
    size = len(unit)
    forward = [0.0] + [_NEVER] * size
    ends: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(size + 1)]
    for j in range(1, size + 1):
        for k in range(min(pieces.longest, j), 0, -1):
            if forward[j - k] == _NEVER:
                continue
            i = pieces.ids.get(unit[j - k : j])
            if i is not None:
                ends[j].append((k, float(pieces.scores[i]), [i]))
            elif k == _LEAD[unit[j - k]]:
                ends[j].append((k, pieces.unknown, [int(pieces.byte_id[b]) for b in unit[j - k : j]]))
            else:
                continue
            forward[j] = max(forward[j], forward[j - k] + ends[j][-1][1])
    found: list[tuple[float, list[int]]] = []
    agenda: list[tuple[float, tuple[int, ...], float, int, tuple]] = [(-forward[size], (), 0.0, size, ())]
    while agenda and len(found) < n:
        _, steps, score, place, path = heapq.heappop(agenda)
        if place == 0:
            ids: list[int] = []
            while path:
                own, path = path
                ids += own
            found.append((score, ids))
            continue
        for k, value, ids in ends[place]:
            heapq.heappush(agenda, (-(score + value + forward[place - k]), (*steps, -k), score + value, place - k, (ids, path)))
    return found


class LongUnit:
    """One unit of any length: its edges by the place where they end, longest first, with their losses.

    The loss of an edge is what the best path to its end is better by than the best one through the edge; a
    path's loss against the best path is the sum of its edges' losses.
    """

    def __init__(self, pieces: Pieces, unit: bytes):
        self.pieces, self.unit, size = pieces, unit, len(unit)
        data = np.frombuffer(unit, np.uint8)
        h = _prefix_hash(data[None, :])[0]
        lead = _LEAD[data]
        own = np.zeros(size, bool)  # characters that are pieces
        parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        power = np.ones(1, np.uint64)
        for k in range(1, min(size, pieces.longest) + 1):
            power = power * _BASE
            if k not in pieces.tables:
                continue
            hashes, ids, seen = pieces.tables[k]
            part = h[k:] - h[: size - k + 1] * power
            at = np.flatnonzero(seen[(part >> np.uint64(48)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(hashes, part[at]), len(hashes) - 1)
            ok = hashes[spot] == part[at]
            at, spot = at[ok], spot[ok]
            own[at[lead[at] == k]] = True
            parts.append((at + k, ids[spot], k))
        for k in range(1, 5):
            at = np.flatnonzero((lead == k) & ~own)
            at = at[at + k <= size]
            parts.append((at + k, np.full(len(at), -1), k))
        end = np.concatenate([e for e, _, _ in parts])
        step = np.concatenate([np.full(len(e), k, np.int16) for e, _, k in parts])
        order = np.lexsort((-step, end))
        end, step, piece = end[order], step[order], np.concatenate([i for _, i, _ in parts]).astype(np.int32)[order]
        value = np.where(piece >= 0, pieces.scores[piece], pieces.unknown)
        self.begin = array("q", np.searchsorted(end, np.arange(size + 2)).tolist())
        self.step, self.piece = array("h", step.tobytes()), array("i", piece.tobytes())
        self._forward(array("d", value.tobytes()))

    def _forward(self, value: array) -> None:
        """Forward Viterbi scores; of each place the best edge, and the least loss of any other edge on the
        best path to it. Scores become losses."""
        size, begin, step = len(self.unit), self.begin, self.step
        forward = array("d", [_NEVER]) * (size + 1)
        forward[0] = 0.0
        self.best, self.other, self.loss = array("q", [-1]) * (size + 1), array("d", [np.inf]) * (size + 1), value
        for j in range(1, size + 1):
            lo, hi = begin[j], begin[j + 1]
            top, at = _NEVER, -1
            for e in range(lo, hi):
                before = forward[j - step[e]]
                value[e] = before + value[e] if before > _NEVER else _NEVER
                if value[e] > top:
                    top, at = value[e], e
            forward[j], self.best[j] = top, at
            if at < 0:
                continue
            least = self.other[j - step[at]]
            for e in range(lo, hi):
                value[e] = top - value[e] if value[e] > _NEVER else np.inf
                if e != at and value[e] < least:
                    least = value[e]
            self.other[j] = least
        self.score = forward[size]

    def _walk(self, bound: float) -> Iterator[tuple[float, array] | float]:
        """The paths of at most that loss, from the end and longer pieces first, as their loss and edges from
        the end to the place where only the best path is left; then the least loss that was turned away."""
        begin, step, loss, other = self.begin, self.step, self.loss, self.other
        edges, losses = array("q"), array("d")
        place, lost, e, beyond = len(self.unit), 0.0, -1, np.inf
        while True:
            if e < 0:  # a new place
                if lost + other[place] > bound or place == 0:
                    beyond = min(beyond, lost + other[place])
                    yield lost, edges
                    e = -2
                else:
                    e = begin[place]
            if e >= 0:
                end = begin[place + 1]
                while e < end and lost + loss[e] > bound:
                    beyond = min(beyond, lost + loss[e])
                    e += 1
                if e < end:
                    edges.append(e)
                    losses.append(lost)
                    lost += loss[e]
                    place -= step[e]
                    e = -1
                    continue
            if not edges:  # every edge of this place is done: back to the one behind it
                break
            e, lost = edges.pop(), losses.pop()
            place += step[e]
            e += 1
        yield float(beyond)

    def ids(self, edges: array) -> np.ndarray:
        """The ids of a path, from its edges at the end and the best path in front of them."""
        place, own = len(self.unit), array("q", edges)
        for e in edges:
            place -= self.step[e]
        while place > 0:
            e = self.best[place]
            own.append(e)
            place -= self.step[e]
        e = np.frombuffer(own, np.int64)[::-1]
        piece, step = np.frombuffer(self.piece, np.int32)[e], np.frombuffer(self.step, np.int16)[e].astype(np.int64)
        width = np.where(piece >= 0, 1, step)
        out = np.repeat(piece, width)
        raw = out < 0
        if raw.any():
            start = np.cumsum(step) - step
            off = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
            data = np.frombuffer(self.unit, np.uint8)
            out[raw] = self.pieces.byte_id[data[(np.repeat(start, width) + off)[raw]]]
        return out

    def n_best(self, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best paths with their scores, by iterative deepening A* from the end."""
        found: list[tuple[float, np.ndarray]] = []
        below, bound = -1.0, 0.0
        while len(found) < n and np.isfinite(bound):
            for x in self._walk(bound + _SAME):
                if isinstance(x, float):
                    below, bound = bound + _SAME, x
                elif x[0] > below:
                    found.append((self.score - x[0], self.ids(x[1])))
                    if len(found) == n:
                        break
        return found


def merged_best(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one score from each list (each sorted, best first), with the ranks taken."""
    start = (0,) * len(lists)
    agenda, seen, out = [(-sum(x[0] for x in lists), start)], {start}, []
    while agenda and len(out) < n:
        cost, ranks = heapq.heappop(agenda)
        out.append((-cost, ranks))
        for k, r in enumerate(ranks):
            after = (*ranks[:k], r + 1, *ranks[k + 1 :])
            if r + 1 < len(lists[k]) and after not in seen:
                seen.add(after)
                heapq.heappush(agenda, (cost + lists[k][r] - lists[k][r + 1], after))
    return out


class Path(NamedTuple):
    """One of the n best paths of a text: where it leaves the best one, first and last token there (the end
    excluded) and what stands in place of them."""

    score: float
    n_tokens: int
    instead: list[tuple[int, int, np.ndarray]]

    def ids(self, best: np.ndarray) -> np.ndarray:
        """The ids of the path, from those of the best one."""
        if not self.instead:
            return best
        parts, at = [], 0
        for lo, hi, own in self.instead:
            parts += [best[at:lo], own]
            at = hi
        return np.concatenate([*parts, best[at:]])


class Encoder:
    """Encodes slices of texts; keeps the N-best lists that it has found for short units."""

    def __init__(self, pieces: Pieces, n: int, remember: int = REMEMBER):
        self.pieces, self.n, self.remember = pieces, n, remember
        self.known: dict[bytes, list[tuple[float, np.ndarray]]] = {}
        self.long: dict[bytes, list[tuple[float, np.ndarray]]] = {}

    def _list(self, unit: bytes) -> list[tuple[float, np.ndarray]]:
        if len(unit) > LONGEST:  # of this slice only
            if unit not in self.long:
                self.long[unit] = LongUnit(self.pieces, unit).n_best(self.n)
            return self.long[unit]
        if unit not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[unit] = [(s, np.array(ids, np.int32)) for s, ids in n_best(self.pieces, unit, self.n)]
        return self.known[unit]

    def encode(self, part: bt.Slice) -> Iterator[tuple[np.ndarray, list[Path]]]:
        """For each text of the slice: ids of its best path, and its n best ones."""
        self.long.clear()
        p = self.pieces
        size = np.diff(part.starts)
        some = size > 0
        data = np.insert(part.data, part.starts[:-1][some], 0x20)
        starts = part.starts + np.concatenate(([0], np.cumsum(some)))
        if not len(data):
            yield from ((np.zeros(0, np.int64), [Path(0.0, 0, [])]) for _ in size)
            return
        space, cut = data == 0x20, p.cut[data]
        lead = cut | space
        lead[1:] &= cut[1:] | ~space[:-1]
        lead[1:] |= cut[:-1] & ~space[1:]
        lead[starts[:-1][some]] = True
        begin = np.flatnonzero(lead)
        long = np.diff(np.append(begin, len(data)))
        off = np.arange(len(data)) - np.repeat(begin, long)
        h = bt.splitmix(np.add.reduceat(bt.BYTE_KEY[data] * bt.place_keys(int(long.max()))[off], begin) + long.astype(np.uint64))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        u_begin, u_long = begin[first], long[first]
        ids, count, score, loss = self._solve(data, u_begin, u_long)
        at = np.cumsum(count) - count
        rows = np.searchsorted(begin, starts)
        for lo, hi in zip(rows[:-1], rows[1:], strict=True):
            units = which[lo:hi]
            n = count[units]
            total = int(n.sum())
            take = np.repeat(at[units] - np.cumsum(n) + n, n) + np.arange(total)
            best = float(score[units].sum())
            yield ids[take], self._n_best(data, u_begin, u_long, units, loss, best, n)

    def _n_best(self, data, begin, long, units, loss, best: float, count: np.ndarray) -> list[Path]:
        own, total = loss[units], int(count.sum())
        if self.n < 2 or not len(own):
            return [Path(best, total, [])]
        m = min(self.n - 1, len(own))
        edge = np.partition(own, m - 1)[m - 1]
        places = np.concatenate([np.flatnonzero(own < edge), np.flatnonzero(own == edge)])[:m]
        places = np.sort(places[np.isfinite(own[places])])
        lists = [self._list(data[begin[u] : begin[u] + long[u]].tobytes()) for u in units[places].tolist()]
        first = (np.cumsum(count) - count)[places].tolist()
        gone = sum(x[0][0] for x in lists)
        out = []
        for score, ranks in merged_best([[s for s, _ in x] for x in lists], self.n):
            instead = [(at, at + len(x[0][1]), x[r][1]) for at, x, r in zip(first, lists, ranks, strict=True) if r]
            out.append(Path(best - gone + score, total + sum(len(ids) - (hi - lo) for lo, hi, ids in instead), instead))
        return out

    def _solve(self, data: np.ndarray, begin: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids (unit after unit), their numbers, scores and second-path losses of distinct units."""
        n = len(begin)
        count, score, loss = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(long, kind="stable")
        cuts = np.flatnonzero(np.diff(long[order], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], n), strict=True):
            size = int(long[order[lo]])
            for a in range(lo, hi, MATRIX if size <= LONGEST else 1):
                units = order[a : min(hi, a + (MATRIX if size <= LONGEST else 1))]
                if size > LONGEST:
                    paths = self._list(data[begin[units[0]] : begin[units[0]] + size].tobytes())[:2]
                    score[units], count[units] = paths[0][0], len(paths[0][1])
                    loss[units] = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
                    found.append((units, paths[0][1]))
                    continue
                lattice = Lattice(self.pieces, data[begin[units][:, None] + np.arange(size)])
                flat, count[units] = lattice.tokens()
                score[units] = lattice.forward[:, size]
                if self.n > 1:
                    loss[units] = lattice.losses()
                found.append((units, flat))
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        for units, flat in found:
            c = count[units]
            ids[np.repeat(at[units] - np.cumsum(c) + c, c) + np.arange(len(flat))] = flat
        return ids, count, score, loss


def decode(pieces: Pieces, ids: np.ndarray) -> bytes:
    """The text of a path: its pieces' bytes without the space in front."""
    n = pieces.size[ids]
    return pieces.all[np.repeat(pieces.begin[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes()[1:]


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


_PATHS = "array<struct<score:double,n_tokens:bigint,ids_sha256:string,exact:boolean,ids:array<int>>>"


def _encoded(pieces: Pieces, n: int, with_ids: bool):
    paths = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("exact", pa.bool_()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, n)
        for batch in batches:
            for part in bt.slices(bt.column(batch, "body"), SLICE):
                rows: dict[str, list] = {"n_tokens": [], "score": [], "ids_sha256": [], "exact": [], "best": [], "ids": []}
                for k, (ids, best) in enumerate(encoder.encode(part)):
                    text = part.data[part.starts[k] : part.starts[k + 1]].tobytes()
                    own = [(p, p.ids(ids)) for p in best]
                    said = [{"score": p.score, "n_tokens": p.n_tokens, "ids_sha256": _sha(x), "exact": decode(pieces, x) == text, "ids": x.astype(np.int32) if with_ids else None} for p, x in own]
                    rows["n_tokens"].append(len(ids))
                    rows["score"].append(best[0].score)
                    rows["ids_sha256"].append(said[0]["ids_sha256"])
                    rows["exact"].append(said[0]["exact"])
                    rows["best"].append(said)
                    rows["ids"].append(said[0]["ids"])
                kinds = (pa.int64(), pa.float64(), pa.string(), pa.bool_(), paths, pa.list_(pa.int32()))
                ids_in = batch.column("doc_id").slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([ids_in, *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], names=["doc_id", *rows])

    return run


def segmented(spark: SparkSession, docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_tokens, score, ids_sha256, exact (whether decoding gives the
    text back), best (the same of each of the n best paths, and its ids), ids (null unless with_ids)."""
    pieces = Pieces.load(model_path)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    kind = dict(texts.dtypes)["doc_id"]
    # written by small Arrow batches, of which a task holds some on both sides of its pipe
    work = Workspace(spark, "segmented")
    return work.write(texts.mapInArrow(bt.lean(_encoded(pieces, n, with_ids)), f"doc_id {kind}, n_tokens bigint, score double, ids_sha256 string, exact boolean, best {_PATHS}, ids array<int>"), "paths")


def _decoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(pieces, np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def desegmented(spark: SparkSession, paths: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    kind = dict(paths.dtypes)["doc_id"]
    return paths.select("doc_id", "ids").mapInArrow(bt.lean(_decoded(Pieces.load(model_path))), f"doc_id {kind}, text string")
