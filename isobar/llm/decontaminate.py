"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are cut into words and every ``K`` consecutive words are hashed once.  Of
the ``WINDOW - K + 1`` k-grams inside a window of ``WINDOW`` words the one of
the smallest hash, the last of equals, is that window's minimum; a text's
fingerprints are the distinct minima of its windows, about two in seven of its
k-grams (Schleimer, Wilkerson and Aiken, 2003).  Two equal windows have their
minimum at the same place, so that every shared span of ``WINDOW`` words or more
has a shared fingerprint inside.

Documents' fingerprints are joined with the benchmark's.  A hit is compared word
for word and extended to the left and to the right, up to ``WINDOW - K`` words
each way: no window that holds the fingerprint reaches farther, and the windows
beyond have fingerprints of their own.  A span of ``WINDOW`` words or more is
found text; the spans of neighbouring fingerprints add up to the whole passage.

Items of fewer than ``WINDOW`` words are one window of their own length, with
the hash of all their words as fingerprint; only lengths that the benchmark has
are looked for, at every word.

A document's fingerprints are made and probed inside one scan stage; only hits
and one row a document are shuffled.  The benchmark's fingerprints are broadcast
while they, counted first, are at most ``BROADCAST_PRINTS``; beyond that the
same join shuffles (adaptive execution splits skewed partitions), with a few
words around each fingerprint and never a whole text.

Defined results: null and empty texts have no words and are clean; an empty
benchmark leaves all documents clean; items with equal texts all count; rows
that repeat a doc_id and its text give one row each; rows of one doc_id with
other texts are judged apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.text import WORD_GAP, lower_ascii, table
from isobar.session import match, materialize

#: Words of a window, and of the hashed k-grams inside it.
WINDOW, K = 10, 5
#: Benchmark fingerprints that are broadcast at most, about 300 bytes each.
BROADCAST_PRINTS = 300_000


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array where there are none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _hash_of(array: str, at: str, length: int) -> str:
    return f"xxhash64({', '.join(f'get({array}, {at} + {j})' for j in range(length))})"


def prints_of(texts: DataFrame, keep: list[str], lengths: list[int], header: bool) -> DataFrame:
    """Fingerprints of each text: ``keep``, n_words, at (their first word), length, fp, words.

    lengths: ``WINDOW`` for the minima, others for the hash of so many words at
    every word.  header: one more row a text with at = -1, whatever it has.
    """
    grams = WINDOW - K + 1
    cut = texts.select(*keep, words_of(F.col("text")).alias("words"))
    cut = cut.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    last = F.size("hashes") - K
    cut = cut.select(*keep, "words", "hashes", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(K)]))).alias("grams"))
    # The generator reads all arrays, so that they are made once a text and not once a row.
    n = F.greatest(F.least(F.size("words"), F.size("hashes")), F.coalesce(F.size("grams") + K - 1, F.lit(0)))
    first = -1 if header else 0
    rows = cut.select(*keep, "words", "hashes", "grams", F.explode(F.when(n >= min(lengths), F.sequence(F.lit(first), n - min(lengths))).otherwise(F.array(F.lit(first)))).alias("at"))
    rows = rows.withColumn("n_words", F.size("words"))
    gram = [f"get(grams, at + {i})" for i in range(grams)]
    before, entering, leaving = f"least({', '.join(gram[:-1])})", gram[-1], "get(grams, at - 1)"
    # The window at ``at`` has another minimum than the one before it if its last k-gram is the smallest, or the one that left was.
    new = f"at >= 0 AND {entering} IS NOT NULL AND (at = 0 OR {entering} <= {before} OR {leaving} < {before})"
    place = f"CASE WHEN {entering} <= {before} THEN at + {grams - 1} " + " ".join(f"WHEN {gram[i]} = {before} THEN at + {i}" for i in reversed(range(grams - 1))) + " END"
    none = F.lit(None).cast("long")
    forms = []
    if WINDOW in lengths:
        forms.append(F.struct(F.lit(WINDOW).alias("length"), F.when(F.expr(new), F.expr(place)).alias("at"), F.when(F.expr(new), F.expr(f"least({', '.join(gram)})")).alias("fp")))
    for m in lengths:
        if m != WINDOW:
            fits = (F.col("at") >= 0) & (F.col("at") <= F.col("n_words") - m)
            forms.append(F.struct(F.lit(m).alias("length"), F.when(fits, F.col("at")).alias("at"), F.when(fits, F.expr(_hash_of("hashes", "at", m))).alias("fp")))
    if len(forms) == 1:
        out = rows.select(*keep, "n_words", F.col("at").alias("_at"), "words", forms[0].alias("f")).where("_at = -1 OR f.fp IS NOT NULL")
        return out.select(*keep, "n_words", F.coalesce("f.at", F.lit(-1)).alias("at"), F.col("f.length").alias("length"), F.col("f.fp").alias("fp"), "words")
    if header:
        forms.append(F.struct(F.lit(0).alias("length"), F.when(F.col("at") == -1, F.lit(-1)).alias("at"), none.alias("fp")))
    return rows.select(*keep, "n_words", "words", F.inline(F.array(*forms))).where("at IS NOT NULL").select(*keep, "n_words", "at", "length", "fp", "words")


#: Words that a fingerprint's windows reach beyond it, on either side.
REACH = WINDOW - K


def _around() -> list[Column]:
    """The words of a fingerprint as a string, and arrays of those before it (nearest first) and after it, null beyond the text."""
    n = F.when(F.col("length") == WINDOW, F.lit(K)).otherwise(F.col("length"))
    own = F.concat_ws(" ", F.slice("words", F.col("at") + 1, n))
    before = F.array(*[F.get("words", F.col("at") - i) for i in range(1, REACH + 1)])
    after = F.array(*[F.get("words", F.col("at") + K - 1 + i) for i in range(1, REACH + 1)])
    return [F.when(F.col("at") >= 0, x).alias(name) for x, name in ((own, "own"), (before, "before"), (after, "after"))]


def benchmark_prints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(length, fp, item_id, own, before, after) of a benchmark (item_id, text), and the lengths there are."""
    cut = benchmark.select(F.col("item_id"), F.col("text"), F.least(F.size(words_of(F.col("text"))), F.lit(WINDOW)).alias("m")).where("m > 0")
    lengths = sorted(r.m for r in cut.select("m").distinct().collect())
    parts = [prints_of(cut.where(F.col("m") == m).select("item_id", "text"), ["item_id"], [m], header=False).where("fp IS NOT NULL") for m in lengths or [WINDOW]]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select("length", "fp", "item_id", *_around()).distinct(), lengths


def _run(side: str) -> Column:
    """How many words in a row agree with the benchmark's, from the fingerprint on."""
    same = F.zip_with(F.col(side), F.col(f"t_{side}"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, F.lit(REACH))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of each document: one header (at = -1), and one for each item that a fingerprint finds.

    Columns doc_id, text_tag (of the text), n_words, at, length (of the span
    found), item_id.
    """
    prints, lengths = benchmark_prints(benchmark)
    prints = materialize(prints, "benchmark-prints")
    small = prints.count() <= BROADCAST_PRINTS
    tagged = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    tagged = tagged.withColumn("text_tag", F.xxhash64("text"))
    rows = prints_of(tagged, ["doc_id", "text_tag"], lengths or [WINDOW], header=True)
    if not small:
        # Rows that are shuffled carry the words around their own place, not their document's.
        rows = rows.select("doc_id", "text_tag", "n_words", "at", "length", "fp", *_around())
    # Headers get keys of their own, so that a shuffled join doesn't deal them all to one task.
    rows = rows.withColumn("key", F.coalesce("fp", F.xxhash64("doc_id", "text_tag", F.lit("header")))).drop("fp")
    names = ["own", "before", "after"]
    side = prints.select(F.col("fp").alias("key"), F.col("length").alias("t_length"), "item_id", *[F.col(c).alias(f"t_{c}") for c in names])
    # The key alone is joined on; what it finds is little, and is compared word for word behind the scan stage.
    found = rows.join(F.broadcast(side) if small else side, "key", "left").where("at = -1 OR t_length = length")
    found = found.select("doc_id", "text_tag", "n_words", "at", "length", "item_id", *[f"t_{c}" for c in names], *(_around() if small else names))
    found = materialize(found, "benchmark-candidates")
    header = F.col("at") == -1
    left, right = _run("before"), _run("after")
    span = F.when(F.col("length") == WINDOW, F.struct((F.col("at") - left).alias("at"), (left + K + right).alias("length"))).otherwise(F.struct(F.col("at").alias("at"), F.col("length").alias("length")))
    found = found.where(header | (F.col("own") == F.col("t_own"))).withColumn("span", F.when(~header, span))
    found = found.where(header | (F.col("length") < WINDOW) | (F.col("span.length") >= WINDOW))
    return found.select("doc_id", "text_tag", "n_words", F.coalesce("span.at", F.lit(-1)).alias("at"), F.col("span.length").alias("length"), F.when(~header, F.col("item_id")).alias("item_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with its hit words and the items found.

    Columns doc_id, text_tag, n_words, n_hit (words inside any occurrence of a
    benchmark window), items (sorted as strings), spans (start and length in
    words of each passage found, touching or overlapping ones joined) and
    contaminated.
    """
    found = hits(docs, benchmark)
    rows = found.groupBy("doc_id", "text_tag").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("at") == -1, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("length")).alias("end"))))).alias("found"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    rows = rows.withColumn("spans", F.aggregate("found", F.expr("CAST(array() AS array<struct<at:int,end:int>>)"), _joined))
    rows = rows.withColumn("spans", F.transform("spans", lambda s: F.struct(s["at"].alias("at"), (s["end"] - s["at"]).alias("length"))))
    rows = rows.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "text_tag", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _joined(spans: Column, s: Column) -> Column:
    """Sorted spans with one more, which joins the last if it begins inside it or at its end."""
    last = F.try_element_at(spans, F.lit(-1))
    longer = F.struct(last["at"].alias("at"), F.greatest(last["end"], s["end"]).alias("end"))
    touches = (F.size(spans) > 0) & (s["at"] <= last["end"])
    return F.when(touches, F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(spans, F.array(F.struct(s["at"].alias("at"), s["end"].alias("end")))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns.

    Only the keys of contaminated rows take part in the anti-join.
    """
    bad = materialize(hits(docs, benchmark).where("at >= 0").select("doc_id", "text_tag").distinct(), "contaminated")
    return match(docs, bad, [(F.col("doc_id"), "doc_id"), (F.xxhash64(F.col("text").cast("string")), "text_tag")], "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, ms)),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": SQL}
