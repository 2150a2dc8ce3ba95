"""Edit-aware token counts: segment trees of pre-tokens.

A text is cut into pre-tokens by the tokenizer's pattern and each is counted by
byte-pair encoding.  Runs of ``LEAF`` pre-tokens are the leaves of a binary tree
whose nodes hold sums of characters and of tokens, so that a count after an edit
needs the touched leaves only: they are cut and counted anew from a border that
the edit can't have moved (``CONTEXT`` characters before it) up to the first new
border that is an old leaf border past the edit, and the sums above are updated.
Where the pattern cuts depends on what follows, never on what precedes, so that
from such a border on the old leaves hold.

Defined results: null texts are empty and have no tokens; edits of a document
apply in the order of ``seq`` (ties: start, end, text), each to the text that
the former one left; positions beyond the text are moved to its end, an end
before its start to the start, and a null replacement is empty.  Rows that
repeat, or share a doc_id with another text, are each a document with a tree of
its own.  Texts of any length are counted whole: a very long one takes memory for
itself and its leaves, and a pre-token of over ``CACHE_CHARS`` characters is
counted without being kept.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.text import batches, table

#: Folder of the public vocabulary files, and the ranks in it.
TOKENIZERS, RANKS = os.environ.get("ISOBAR_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: The public pattern that goes with these ranks (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf, and the longest look-ahead of the pattern past a border.
LEAF, CONTEXT = 64, 4
#: Pre-tokens whose counts a task keeps, those up to so many characters.
CACHE, CACHE_CHARS = 500_000, 40


class Counter:
    """Counts the tokens of pre-tokens; made of rank lines, once in a task."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        self.ranks, self.pattern, self._made = ranks, pattern, None

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        (self.ranks, self.pattern), self._made = state, None

    @classmethod
    def load(cls, path: str | None = None) -> Counter:
        with open(path or os.path.join(TOKENIZERS, RANKS), "rb") as f:
            return cls(f.read())

    def _ready(self):
        if self._made is None:
            import regex
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.ranks.splitlines() if x)}
            held = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._made = regex.compile(self.pattern), held, {}
        return self._made

    def cut(self, text: str, at: int = 0):
        """Pre-tokens from a border on, one by one."""
        return (m.group() for m in self._ready()[0].finditer(text, at))

    def counts(self, pretokens: list[str]) -> list[int]:
        _, held, cache = self._ready()
        out = []
        for x in pretokens:
            if (n := cache.get(x)) is None:
                n = len(held.encode_ordinary(x))
                if len(x) <= CACHE_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[x] = n
            out.append(n)
        return out

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf of a whole text."""
        found = self._ready()[0].findall(text)
        n, chars = self.counts(found), list(map(len, found))
        return [sum(chars[i : i + LEAF]) for i in range(0, len(found), LEAF)], [sum(n[i : i + LEAF]) for i in range(0, len(found), LEAF)]


class Tree:
    """Sums of characters and tokens over leaves, as a heap-ordered binary tree."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, (max(self.n, 1) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if self.n:
            self.sums[self.width : self.width + self.n] = np.stack([chars, tokens], axis=1)
        level = self.width // 2
        while level:
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level : 2] + self.sums[2 * level + 1 : 4 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if position >= begin + self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def size(self, leaf: int) -> int:
        return int(self.sums[self.width + leaf, 0])

    def leaf_values(self) -> tuple[list[int], list[int]]:
        own = self.sums[self.width : self.width + self.n]
        return own[:, 0].tolist(), own[:, 1].tolist()

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """New values of a leaf; the sums above follow."""
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class Document:
    """A text with its tree."""

    def __init__(self, counter: Counter, text: str | None, leaves: tuple[list[int], list[int]] | None = None) -> None:
        self.counter, self.text = counter, text or ""
        self.tree = Tree(*(leaves or counter.leaves(self.text)))
        self.recounted = 0
        #: Edits after which the tree was made anew.
        self.rebuilt = 0

    def edit(self, start: int, end: int, new: str | None) -> None:
        """Replaces characters start to end; counts only what that touches."""
        old, tree, new = self.text, self.tree, new or ""
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        self.text = old[:start] + new + old[end:]
        grown = len(new) - (end - start)
        if not tree.n or not old:
            self.tree = Tree(*self.counter.leaves(self.text))
            self.recounted += len(self.text)
            self.rebuilt += 1
            return
        first, begin = tree.leaf_at(max(0, start - CONTEXT))
        # Old leaf borders past the edit, one by one, as places in the new text.
        last, border = tree.leaf_at(max(end - 1, 0))
        border += tree.size(last)
        while border < end:
            last += 1
            border += tree.size(last)
        at, pieces = begin, []
        for x in self.counter.cut(self.text, begin):
            pieces.append(x)
            at += len(x)
            while at > border + grown and last + 1 < tree.n:
                last += 1
                border += tree.size(last)
            if at == border + grown and at >= start + len(new):
                break
        self.recounted += at - begin
        chars, n = list(map(len, pieces)), self.counter.counts(pieces)
        room = last - first + 1 if at == border + grown else tree.n - first
        each = max(1, -(-len(pieces) // room))
        if each > 2 * LEAF:
            # The region outgrew its leaves: the leaf row is made anew, counts outside stay.
            a, b = tree.leaf_values()
            mid = range(0, len(pieces), LEAF)
            self.tree = Tree(a[:first] + [sum(chars[i : i + LEAF]) for i in mid] + a[first + room :], b[:first] + [sum(n[i : i + LEAF]) for i in mid] + b[first + room :])
            self.rebuilt += 1
            return
        # Leaves without pre-tokens hold nothing; the sums above follow.
        for k in range(room):
            tree.put(first + k, sum(chars[k * each : (k + 1) * each]), sum(n[k * each : (k + 1) * each]))


_TREE = "doc_id long, text_tag long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def _ints(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def token_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_tag (a hash of the text), n_tokens and its tree's leaves."""
    held = docs.sparkSession.sparkContext.broadcast(Counter.load(path))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [held.value.leaves(t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2), pa.array([sum(b) for _, b in found], pa.int64()), _ints([a for a, _ in found]), _ints([b for _, b in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_tag", "n_tokens", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _tag().alias("text_tag")).mapInArrow(run, _TREE)


def _tag():
    return F.xxhash64(F.col("text").cast("string"))


def apply_edits(rows: DataFrame, path: str | None = None, kept: bool = False) -> DataFrame:
    """Counts before and after the edits of each row, with the new text and leaves.

    rows: doc_id, text, edits (array of struct seq, start, end, new), and, if
    ``kept``, the trees' leaf_chars and leaf_tokens, which spare the first count.
    """
    held = rows.sparkSession.sparkContext.broadcast(Counter.load(path))
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits")]
    columns += [F.col(c).cast("array<int>") if kept else F.lit(None).cast("array<int>").alias(c) for c in ("leaf_chars", "leaf_tokens")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            out: list[list] = [[] for _ in range(7)]
            for text, edits, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                doc = Document(held.value, text, (a, b) if a is not None and b is not None else None)
                before, chars = doc.tree.tokens, len(doc.text)
                order = sorted((e for e in edits or () if e), key=lambda e: (e["seq"] or 0, e["start"] or 0, e["end"] or 0, e["new"] or ""))
                for e in order:
                    doc.edit(e["start"] or 0, e["end"] or 0, e["new"])
                a, b = doc.tree.leaf_values()
                for column, value in zip(out, (before, chars, doc.tree.tokens, doc.recounted, doc.text, a, b), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_tokens", "n_chars", "n_tokens_after", "chars_recounted", "text", "leaf_chars", "leaf_tokens"])

    return rows.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, n_chars long, n_tokens_after long, chars_recounted long, text string, leaf_chars array<int>, leaf_tokens array<int>")


def edit_trees(trees: DataFrame, docs: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Counts after an edit log (doc_id, seq, start, end, new), for edited documents only.

    An entry holds for all rows with its doc_id (null for those without one).  A
    row's tree is that of its doc_id and text, so rows that share a doc_id keep
    their own; repeated rows share one.  Documents without edits aren't read past
    that join; a document without a tree is counted anew.
    """
    log = edits.groupBy(F.col("doc_id").cast("long").alias("_log_id")).agg(F.collect_list(F.struct("seq", "start", "end", "new")).alias("edits"))
    edited = docs.select(F.col("doc_id").cast("long"), "text", _tag().alias("_tag")).join(log, F.col("doc_id").eqNullSafe(F.col("_log_id")))
    held = trees.select(F.col("doc_id").alias("_tree_id"), "text_tag", "leaf_chars", "leaf_tokens").dropDuplicates(["_tree_id", "text_tag"])
    rows = edited.join(held, F.col("doc_id").eqNullSafe(F.col("_tree_id")) & (F.col("_tag") == F.col("text_tag")), "left")
    return apply_edits(rows, path, kept=True)


def derived_edits(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with three edits each, made of its own values.

    The source's name goes in at a third of the text, 40 characters around the
    middle go out, and the last 12 give way to the language's name.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0))

    def edit(seq: int, start, end, new):
        return F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("new"))

    added = F.concat(F.lit(" "), F.coalesce(F.col("source"), F.lit("")), F.lit(" "))
    size = n + F.char_length(added)
    third = edit(1, F.floor(n / 3), F.floor(n / 3), added)
    middle = edit(2, F.greatest(F.floor(size / 2) - 20, F.lit(0)), F.floor(size / 2) + 20, F.lit(""))
    end = edit(3, F.greatest(size - 52, F.lit(0)), size, F.coalesce(F.col("lang"), F.lit("")))
    return docs.select("doc_id", "text", F.array(third, middle, end).alias("edits"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_edits(derived_edits(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_chars", "n_tokens", "n_tokens_after", "chars_recounted")


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
