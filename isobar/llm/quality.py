"""Quality scores from two compression dictionaries.

One zstandard dictionary is trained on pieces of texts labelled good, another on
pieces of bad ones.  Each whole text is compressed piece by piece with either;
the difference of the summed sizes over the text's own size is its feature (so
that words repeated over and over, which either dictionary compresses well, say
little), and a logistic curve fitted on labelled texts that the dictionaries
haven't seen turns it into a score.  ``WEIGHT`` bytes of a usual good text stand
beside each text, so that a few words alone don't condemn it.

Fitting reads bounded samples: by label, the ``TEXTS`` texts whose doc_id hashes
least for the dictionaries, of whose pieces of ``PIECE`` bytes the ``PIECES``
with the least hash are trained on, and as many texts for the curve.

Defined results: null and empty texts have the feature of that usual good text alone; without labels of both
kinds every score is the share of good labels (0.5 without any); a doc_id with
several labels counts with each; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm.text import batches, table, texts_of
from isobar.session import materialize

PIECE, PIECES, TEXTS, DICTIONARY, LEVEL, PASS = 2048, 3000, 2000, 1 << 16, 3, 0.7
#: Bytes of a usual good text that stand beside each text.
WEIGHT = 40


@dataclass
class Model:
    """Two dictionaries and the curve; an empty dictionary leaves the share of good labels."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0
    prior: float = 0.0
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.offset, self.prior

    def __setstate__(self, state):
        self.good, self.bad, self.slope, self.offset, self.prior = state
        self._made = []

    def _compressors(self) -> list:
        if not self._made:
            import zstandard

            for data in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(data)
                held.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._made

    def feature(self, text: bytes | None) -> float:
        """(bad size - good size) / size over all pieces, drawn to ``prior`` in short texts."""
        if not self.good or not self.bad:
            return 0.0
        text = text or b""
        good, bad = (sum(len(c.compress(text[at : at + PIECE])) for at in range(0, len(text), PIECE)) for c in self._compressors())
        return (bad - good + WEIGHT * self.prior) / (len(text) + WEIGHT)

    def score(self, feature: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * feature + self.offset))))


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    import zstandard

    total = sum(map(len, samples))
    if total < 20 * 1024 or len(samples) < 16:
        return b"".join(samples)[-size:]
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit (Newton's method, a weak ridge on the slope)."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.array([1e-3 * len(x), 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _bucket(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(_bucket(4) == 2, F.lit(False))


def _limit(most: int, n: int) -> int:
    """A bound on a uniform 63-bit hash that about 3 * ``most`` of ``n`` rows are under."""
    return min(2**63 - 1, int(3 * most / max(n, 1) * 2**63))


def _pieces(docs: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(quality, piece, rank) of the pieces of whole texts whose hash is within the label's limit."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(rows):
            label, piece, rank = [], [], []
            for q, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                for at in range(0, len(text or b""), PIECE):
                    hashed = xxhash.xxh64_intdigest(own := text[at : at + PIECE]) >> 1
                    if hashed <= limits[q]:
                        label.append(q)
                        piece.append(own)
                        rank.append(hashed)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(piece, pa.binary()), pa.array(rank, pa.int64())], ["quality", "piece", "rank"])

    return docs.select(F.col("quality").cast("int"), F.col("text").cast("string")).mapInArrow(run, "quality int, piece binary, rank long")


def _least(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of each label that come first by ``by``; ``rows`` are few already."""
    order = Window.partitionBy("quality").orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def sample_labels(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, quality, curve) of the labels to learn from, and how many labels there are.

    At most ``TEXTS`` labels of each kind for the dictionaries, and as many for
    the curve (doc_ids whose crc32 modulo 4 is 3): those whose doc_id hashes
    least.  Labels alone are counted and ranked; no text takes part.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    marks = marks.withColumn("curve", _bucket(4) == 3).withColumn("rank", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    sizes = marks.groupBy("quality", "curve").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {q: sum(r.n for r in sizes if r.quality == q) for q in {r.quality for r in sizes}}
    near = F.lit(False)
    for r in sizes:
        near = near | ((F.col("quality") == r.quality) & (F.col("curve") == r.curve) & (F.col("rank") <= _limit(TEXTS, r.n)))
    order = Window.partitionBy("quality", "curve").orderBy("rank", "doc_id")
    ranked = marks.where(near).withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= TEXTS).select("doc_id", "quality", "curve"), counts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); learns from all labels given.

    The sampled labels, at most 4 * ``TEXTS`` rows, are broadcast, so that texts
    are filtered where they are read.
    """
    sample, counts = sample_labels(labels)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    flat = Model(b"", b"", 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(counts) < 2:
        return flat
    side = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(side, F.col("doc_id") == F.col("_id"))
    rows = materialize(rows.where("text <> ''").select("doc_id", "text", "quality", "curve"), "labelled")
    base = rows.where("not curve")
    sizes = base.groupBy("quality").agg(F.sum(F.ceil(F.octet_length("text") / PIECE)).alias("pieces")).collect()
    limits = {r.quality: _limit(PIECES, int(r.pieces)) for r in sizes}
    found = _least(_pieces(base, limits), ["rank", "piece"], PIECES).orderBy("quality", "rank", "piece").toPandas()
    pieces = {q: [bytes(p) for p in found.piece[found.quality == q]] for q in (0, 1)}
    if not pieces[0] or not pieces[1]:
        return flat
    model = Model(dictionary(pieces[1]), dictionary(pieces[0]))
    apart = rows.where("curve")
    pairs = features(apart, model, "quality").orderBy("tag", "feature").toPandas()
    if pairs.empty or pairs.tag.nunique() < 2:
        return flat
    model.prior = max(0.0, float(pairs.feature[pairs.tag == 1].quantile(0.25)))
    pairs = features(apart, model, "quality").orderBy("tag", "feature").toPandas()
    # Both labels weigh as they do among all labels, whatever the sample took of each.
    slope, offset = curve(pairs.feature.to_numpy(), pairs.tag.to_numpy(float))
    n1, n0 = int((pairs.tag == 1).sum()), int((pairs.tag == 0).sum())
    model.slope, model.offset = slope, offset + math.log((counts[1] / counts[0]) / (n1 / n0))
    return model


def features(docs: DataFrame, model: Model, tag: str = "doc_id") -> DataFrame:
    """(tag, feature, score) of each row; the model (two small dictionaries) is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = [held.value.feature(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(map(held.value.score, found), pa.float64())], ["tag", "feature", "score"])

    return docs.select(F.col(tag).cast("long"), F.col("text").cast("string")).mapInArrow(run, "tag long, feature double, score double")


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = features(docs, fit_documents(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("tag", "doc_id")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= PASS, 1).otherwise(0).alias("predicted"), "feature")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
