"""Ranked lexical search by the Best Position Algorithm over impact lists.

A document's score for an item sums, over the item's terms, the term's weight
times an integer impact (of its occurrences and the document's length).  Three
passes, none of which shuffles postings:

1. Every text is cut into terms once; a row a document keeps its length and the
   terms that any item asks for, with their occurrences.  This table is written
   (an array of numbers a document, no texts).
2. The number of documents, their terms and the documents of each term are
   counted over it; tasks add up arrays first.
3. Tasks read the table in shards of ``SHARD_ROWS`` documents.  In a shard every
   term's postings are sorted by impact, and each item is answered by the Best
   Position Algorithm (Akbarinia, Pacitti and Valduriez, 2007): lists are read in
   step, a document seen in one is looked up in all others by direct access, and
   all its positions count as seen.  A list's best position ends its contiguous
   seen stretch; no unseen document has more of a term than stands just below it.
   When the sum of these bounds is strictly below the k-th score, no other
   document can reach it, nor tie with it.  The k-th score is carried from shard
   to shard of a task, so later shards stop sooner.

Each task gives at most k rows an item, which are ranked by window.  The items'
terms are sent to the tasks in groups of at most ``TERM_BYTES`` bytes; items of
more terms than that take more passes, each over all documents.

Defined results: null texts and texts without terms are no documents and no
items.  Rows that share an item_id (null included) are one item with the terms
of all.  Rows that repeat a doc_id are each a document; a null doc_id is the last
among equal scores.  Among rows with equal scores and doc_ids ranks are given in
any order.  Texts of any length are read in stretches.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm.resample import stretches
from isobar.llm.text import batches, table, texts_of
from isobar.session import materialize

#: Documents and postings of a shard at most (a document is never cut).
SHARD_ROWS, SHARD_POSTINGS = 8192, 2_000_000
#: Bytes of distinct terms that are sent to a task at once.
TERM_BYTES = 32 << 20
#: Positions of each list that are read before the first test; later steps double.
FIRST_STEP = 8


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                for words in stretches(text):
                    held = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(held), pa.int64()), pa.array(held, pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, term binary").distinct()


def _groups(asked: DataFrame) -> Iterator[dict[int | None, list[bytes]]]:
    """Items with their terms, in groups whose terms have ``TERM_BYTES`` bytes at most (or one item each)."""
    group: dict[int | None, list[bytes]] = {}
    size = 0
    for row in asked.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).orderBy("item_id").toLocalIterator():
        more = sum(len(t) + 64 for t in row.terms)
        if group and size + more > TERM_BYTES:
            yield group
            group, size = {}, 0
        group[row.item_id] = [bytes(t) for t in row.terms]
        size += more
    yield group


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): of each document with a term its length and the asked terms (ascending) with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches(rows):
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                counts: Counter[bytes] = Counter()
                for words in stretches(text):
                    counts.update(words)
                if counts:
                    held = sorted((number[w], n) for w, n in counts.items() if w in number)
                    ids.append(doc_id)
                    sizes.append(counts.total())
                    terms.append([t for t, _ in held])
                    tfs.append([n for _, n in held])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, sizes, terms, tfs), kinds, strict=True)], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<bigint>")


def frequencies(held: DataFrame, size: int) -> np.ndarray:
    """How many rows of ``postings`` hold each of the ``size`` terms; as many numbers come to the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in rows:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in held.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


class Shard:
    """Impact lists of some documents: by term in falling impact, and by document for direct access."""

    def __init__(self, ids: list[int | None], terms: list[np.ndarray], impacts: list[np.ndarray], vocabulary: int) -> None:
        self.ids = ids
        sizes = np.array([len(t) for t in terms], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        self.impact = np.concatenate([*impacts, np.empty(0, np.int64)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((self.doc, -self.impact, self.term))
        self.length = np.bincount(self.term, minlength=vocabulary)
        self.start = np.cumsum(self.length) - self.length
        self.by_impact = order
        self.place = np.empty(len(order), np.int64)  # of a posting in its term's list
        self.place[order] = np.arange(len(order)) - self.start[self.term[order]]
        self._own = np.full(vocabulary, -1, np.int64)
        self.reads = 0  # postings read in order, for tests

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of those that may be among the k best: all with a score above 0 that reach the k-th and ``floor``."""
        use = (weights > 0) & (self.length[terms] > 0)
        terms, weights = terms[use], weights[use]
        if not len(terms):
            return []
        start, length = self.start[terms], self.length[terms]
        self._own[terms] = np.arange(len(terms))
        offset = np.concatenate([[0], np.cumsum(length + 1)])[:-1]  # an unseen place more ends each list
        seen = np.zeros(int((length + 1).sum()), bool)
        known = np.zeros(len(self.ids), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step, best = 0, FIRST_STEP, np.zeros(len(terms), np.int64)
        while True:
            places = np.arange(at, at + step)
            inside = places < length[:, None]
            self.reads += int(inside.sum())
            new = np.unique(self.doc[self.by_impact[(start[:, None] + places)[inside]]])
            new = new[~known[new]]
            at, step = at + step, 2 * step
            if len(new):
                known[new] = True
                # Direct access: all postings of the new documents, those of other terms left out.
                sizes = self.first[new + 1] - self.first[new]
                row = np.repeat(np.arange(len(new)), sizes)
                post = np.arange(int(sizes.sum())) + np.repeat(self.first[new] - (np.cumsum(sizes) - sizes), sizes)
                own = self._own[self.term[post]]
                row, post, own = row[own >= 0], post[own >= 0], own[own >= 0]
                total = np.zeros(len(new), np.int64)
                np.add.at(total, row, weights[own] * self.impact[post])
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total])
                seen[offset[own] + self.place[post]] = True
            best = _advanced(seen, offset, length, best, step)
            open_ = best < length
            bound = int((weights[open_] * self.impact[self.by_impact[start[open_] + best[open_]]]).sum())
            least = floor
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if bound < least or not open_.any():
                break
        self._own[terms] = -1
        take = (scores > 0) & (scores >= least)
        return list(zip(scores[take].tolist(), docs[take].tolist(), strict=True))


def _advanced(seen: np.ndarray, offset: np.ndarray, length: np.ndarray, best: np.ndarray, width: int) -> np.ndarray:
    """The first unseen place of each list at or after ``best``; the list's length if all are seen."""
    best, todo = best.copy(), np.arange(len(best))
    while len(todo):
        places = np.minimum(best[todo, None] + np.arange(width), length[todo, None])
        unseen = ~seen[offset[todo, None] + places]
        ends = unseen.any(axis=1)
        best[todo] = np.where(ends, places[np.arange(len(todo)), unseen.argmax(axis=1)], best[todo] + width)
        todo = todo[~ends]
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    out = None
    for group in _groups(materialize(terms_of(items), "item-terms")):
        found = _search(docs, group, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: dict[int | None, list[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in items.values() for t in terms}))}
    held = materialize(postings(docs, vocabulary), "postings")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(held, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = [(item, np.array([vocabulary[t] for t in terms], np.int64)) for item, terms in items.items()]
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_term = shared.value
        held_: list[list[tuple]] = [[] for _ in own]
        for shard in _shards(batches_, n_docs, n_terms, len(of_term)):
            for i, (_, terms) in enumerate(own):
                floor = -held_[i][k - 1][0] if len(held_[i]) >= k else 0
                found = [(-s, shard.ids[d] is None, shard.ids[d] or 0) for s, d in shard.best(terms, of_term[terms], k, floor)]
                held_[i] = sorted(held_[i] + found)[:k]
        rows = [(item, None if null else doc, -s) for (item, _), best in zip(own, held_, strict=True) for s, null, doc in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = held.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item_id long, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _shards(rows: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, vocabulary: int) -> Iterator[Shard]:
    """Shards of the rows of ``postings`` that a task reads; impacts come from the corpus' counts."""
    ids: list[int | None] = []
    terms: list[np.ndarray] = []
    impacts: list[np.ndarray] = []
    size = 0
    for batch in rows:
        sizes = batch.column(1).to_pylist()
        columns = [(c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])) for c in (batch.column(2), batch.column(3))]
        (flat, ends), (tfs, _) = columns
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            m = 10 + 90 * sizes[i] * n_docs // n_terms
            a, b = int(ends[i]), int(ends[i + 1])
            if ids and (len(ids) >= SHARD_ROWS or size + b - a > SHARD_POSTINGS):
                yield Shard(ids, terms, impacts, vocabulary)
                ids, terms, impacts, size = [], [], [], 0
            ids.append(doc_id)
            terms.append(flat[a:b])
            impacts.append(1_000_000_000 * tfs[a:b] // (1000 * tfs[a:b] + 8 * m))
            size += b - a
    if ids:
        yield Shard(ids, terms, impacts, vocabulary)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT item_id, {_TERMS} AS w FROM benchmark)),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * f + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS f FROM t GROUP BY term), n),
s AS (
  SELECT q.item_id, t.doc_id, CAST(sum(df.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * n.n_docs) // n.n_terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN df USING (term), n GROUP BY q.item_id, t.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE = {"op13_lexical_search": SQL}
