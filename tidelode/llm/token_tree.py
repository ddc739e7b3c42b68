"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A byte-level BPE encodes each pre-token (a match of the vocabulary's pattern) by itself, so a text's number
of tokens is a sum over its pre-tokens. A document keeps a segment tree over runs of pre-tokens: leaves hold
the text, bounds and counts of up to LEAF pre-tokens, inner nodes sums of characters and tokens. An edit
re-reads the pattern from the last pre-token that it cannot reach back to, until a new bound falls on an old
one behind the edit; only new pre-tokens are encoded, the leaves concerned are replaced, and sums change along
their paths. The text exists in the leaves alone, so an edit costs what it touches and the height of the tree.

How far back a match depends on the text: the pattern looks at most two characters past a match's end
(white space before a word; a contraction), so pre-tokens that end CONTEXT characters before an edit stand.

Defined cases: null and empty texts have no tokens; an edit outside of the text fails; edits of one
document are applied in order, each on the text that the one before left; rows that repeat, and repeated or
null identifiers, are each returned; an empty table gives no rows; a very long text is held whole by one task,
where a single pre-token of any length is encoded in one go. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import bytetext as bt

#: The published split pattern of the 50k byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that a match may depend on; pre-tokens of a leaf; pre-tokens whose counts a task remembers.
CONTEXT, LEAF, REMEMBER = 3, 64, 500_000

#: Personal data that the registered query edits out, with the tag put in its place.
PERSONAL = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}", "[PHONE]"),
    (r"\b\d{13,19}\b", "[NUMBER]"),
)


class Counter:
    """Tokens of pre-tokens, by the merge ranks of a tiktoken file's content."""

    def __init__(self, content: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.coding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = {w for w in words if w not in known}
        self.encoded += len(words)
        if new:
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = set(words)
            one = self.coding._core_bpe.encode_single_piece
            known.update((w, len(one(w.encode("utf-8", "surrogatepass")))) for w in new)
        return [known[w] for w in words]


class _Node:
    """A node: its sums and, of a leaf, the text, lengths in characters and tokens of some pre-tokens in a row."""

    __slots__ = ("after", "before", "chars", "left", "lengths", "right", "text", "tokens", "up", "values")

    def __init__(self, text: str = "", lengths: list[int] | None = None, values: list[int] | None = None):
        self.left: _Node | None = None
        self.right: _Node | None = None
        self.up: _Node | None = None
        self.before: _Node | None = None  # neighbours among leaves
        self.after: _Node | None = None
        self.put(text, lengths or [], values or [])

    def put(self, text: str, lengths: list[int], values: list[int]) -> None:
        self.text, self.lengths, self.values = text, lengths, values
        self.chars, self.tokens = len(text), sum(values)


class TokenTree:
    """The segment tree of one text.

    A leaf that edits make too large becomes an inner node over leaves of its parts; leaves that edits empty
    stay with sums of 0. When the tree has become too high, or has too many empty leaves, it is built anew
    from its leaves, which splits or encodes no text and happens after as many changes as leaves.
    """

    def __init__(self, counter: Counter, text: str):
        self.counter = counter
        words = counter.split.findall(text)
        self.reread = 0
        self._build(self._cut(text, [len(w) for w in words], counter.counts(words)))

    @staticmethod
    def _cut(text: str, lengths: list[int], values: list[int]) -> list[_Node]:
        """Leaves of up to LEAF pre-tokens, at least one."""
        out, at = [], 0
        for k in range(0, len(lengths), LEAF):
            own = lengths[k : k + LEAF]
            size = sum(own)
            out.append(_Node(text[at : at + size], own, values[k : k + LEAF]))
            at += size
        return out or [_Node()]

    def _build(self, leaves: list[_Node]) -> None:
        for a, b in zip(leaves[:-1], leaves[1:], strict=True):
            a.after, b.before = b, a
        leaves[0].before = leaves[-1].after = None
        self.first, self.empty, self.number = leaves[0], 0, len(leaves)
        self.root, self.highest = self._over(leaves), 2 * len(leaves).bit_length() + 8
        self.root.up = None

    @staticmethod
    def _over(leaves: list[_Node]) -> _Node:
        """A balanced tree over leaves."""
        level = leaves
        while len(level) > 1:
            up = []
            for k in range(0, len(level) - 1, 2):
                node = _Node()
                node.left, node.right = level[k], level[k + 1]
                node.left.up = node.right.up = node
                node.chars, node.tokens = node.left.chars + node.right.chars, node.left.tokens + node.right.tokens
                up.append(node)
            level = up + level[len(level) // 2 * 2 :]
        return level[0]

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def leaves(self) -> list[_Node]:
        out, leaf = [], self.first
        while leaf:
            out.append(leaf)
            leaf = leaf.after
        return out

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.leaves)

    def _leaf_at(self, place: int) -> tuple[_Node, int]:
        """The leaf that holds a character (or the last one with text), and the characters in front of it."""
        node, before = self.root, 0
        while node.left:
            if place >= before + node.left.chars and node.right.chars:
                before += node.left.chars
                node = node.right
            else:
                node = node.left
        return node, before

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces the characters start to end of the text."""
        if not 0 <= start <= end <= self.root.chars:
            raise ValueError("the edit is outside of the text")
        shift = len(put) - (end - start)
        # the last pre-token that cannot depend on the edit ends at most here
        first, begin = self._leaf_at(max(0, start - CONTEXT))
        while first.before and begin > start - CONTEXT:
            first = first.before
            begin -= first.chars
        at, kept = begin, 0
        while kept < len(first.lengths) and at + first.lengths[kept] + CONTEXT <= start:
            at += first.lengths[kept]
            kept += 1
        # the text from there on, as far as leaves have been looked at
        seen, old = first, [first.text[at - begin :]]
        until = begin + first.chars
        while until < end and seen.after:
            seen = seen.after
            old.append(seen.text)
            until += seen.chars
        old_text = "".join(old)
        text = old_text[: start - at] + put + old_text[end - at :]
        # old bounds behind the edit, leaf by leaf as the new matches come to them
        last, bound, inner = first, at, kept
        words: list[str] = []
        place, met = 0, False  # in text
        match = self.counter.split.match
        while True:
            found = None
            while place < len(text):
                found = match(text, place)
                if found.end() + CONTEXT <= len(text) or not seen.after:
                    break
                # what comes next may change the match
                seen = seen.after
                text += seen.text
            if place >= len(text) and seen.after:
                seen = seen.after
                text += seen.text
                continue
            while bound + shift < at + place or bound < end:
                while inner == len(last.lengths) and last.after and last is not seen:
                    last, inner = last.after, 0
                if inner == len(last.lengths):
                    break
                bound += last.lengths[inner]
                inner += 1
            if bound >= end and bound + shift == at + place:
                met = True
                break
            if found is None:  # the end of the text
                break
            words.append(found.group())
            place = found.end()
        if not met:
            last, inner = seen, len(seen.lengths)
        self.reread += len(words)
        tail = last.text[sum(last.lengths[:inner]) :]
        own = (first.text[: at - begin] + text[:place] + tail, first.lengths[:kept] + [len(w) for w in words] + last.lengths[inner:], first.values[:kept] + self.counter.counts(words) + last.values[inner:])
        while first is not last:  # what the edit has swallowed stays as an empty leaf
            self._put(last, "", [], [])
            last = last.before
        self._put(first, *own)
        if len(first.lengths) > 2 * LEAF:
            self._part(first)
        if self.empty > self.number // 2 + 8:
            self._build([x for x in self.leaves if x.lengths] or [self.first])

    def _put(self, leaf: _Node, text: str, lengths: list[int], values: list[int]) -> None:
        """New content of a leaf, with the sums above it."""
        chars, tokens, self.empty = leaf.chars, leaf.tokens, self.empty + (bool(leaf.lengths) - bool(lengths))
        leaf.put(text, lengths, values)
        more_chars, more_tokens = leaf.chars - chars, leaf.tokens - tokens
        node = leaf.up
        while node:
            node.chars += more_chars
            node.tokens += more_tokens
            node = node.up

    def _part(self, leaf: _Node) -> None:
        """Puts leaves of its parts in place of a leaf."""
        parts = self._cut(leaf.text, leaf.lengths, leaf.values)
        self.number += len(parts) - 1
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            a.after, b.before = b, a
        parts[0].before, parts[-1].after = leaf.before, leaf.after
        if leaf.before:
            leaf.before.after = parts[0]
        else:
            self.first = parts[0]
        if leaf.after:
            leaf.after.before = parts[-1]
        node, up = self._over(parts), leaf.up
        node.up = up
        if up is None:
            self.root = node
        elif up.left is leaf:
            up.left = node
        else:
            up.right = node
        height = len(parts).bit_length()
        while up:
            height, up = height + 1, up.up
        if height > self.highest:
            self._build([x for x in self.leaves if x.lengths] or [self.first])


def personal_edits(patterns: list, text: str) -> list[tuple[int, int, str]]:
    """The matches of personal data, from the last one on, so that places stay true as they are applied."""
    found: list[tuple[int, int, str]] = []
    for pattern, tag in patterns:
        found += [(m.start(), m.end(), tag) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out[::-1]


def read_ranks(path: str) -> bytes:
    """The content of a tiktoken file; the driver reads it and tasks get it with their code."""
    with open(path, "rb") as f:
        return f.read()


def _edited(content: bytes, with_edits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content)
        patterns = [(regex.compile(p), tag) for p, tag in PERSONAL]
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            edits_in = batch.column("edits").to_pylist() if with_edits else None
            for k, text in enumerate(bt.column(batch, "text").to_pylist()):
                tree = TokenTree(counter, text)
                before, n = tree.total, sum(len(x.lengths) for x in tree.leaves)
                edits = [(e["start"], e["end"], e["put"] or "") for e in edits_in[k] or ()] if with_edits else personal_edits(patterns, text)
                for e in edits:
                    tree.edit(*e)
                rows.append((before, tree.total, len(edits), n, tree.reread))
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(cols[:, k].copy()) for k in range(5))], names=["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_pretokens", "n_reread"])

    return run


def edited_counts(spark: SparkSession, docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_tokens_after (its edits), n_edits, n_pretokens and
    n_reread (pre-tokens that the edits had split again).

    edits_col holds array<struct<start, end, put>> in characters, applied in order; without it personal
    data is edited out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(edits_col).alias("edits")] if edits_col else []))
    return rows.mapInArrow(_edited(read_ranks(ranks_path), edits_col is not None), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, n_tokens_after bigint, n_edits bigint, n_pretokens bigint, n_reread bigint")
