"""Language identification by nearest centroid over TF-IDF n-grams.

Texts are lower-cased, all but letters become single blanks, and the UTF-8
bytes' 2-, 3- and 4-grams are counted in ``DIMS`` hashed bins.  Logarithmic
term weights times IDF, normalised, are compared by cosine with the centroids;
each language has up to ``CENTROIDS`` of them, clustered by spherical k-means.
A text is rejected if it is farther from the nearest centroid than the
language's radius for texts of as many bins, or has no letters.  Radii come from
the cosines of training texts and of their short beginnings with centroids
fitted without them (two folds): the cosine must reach ``SHARE`` of the
``LOW`` quantile of its class, a class being a power of two of bins that occur.

Fitting reads a bounded sample: of each language the ``SAMPLE`` labelled texts
whose doc_id hashes least, a choice that depends on nothing else.  Each language
is clustered in a task of its own and every language is learned; the fitted rows
stay in the shared folder, ``PART`` languages together.  The driver gets the IDF
and a few numbers.  Prediction reads every whole text, in slices of ``PIECE``
bytes whose counts add up, and compares a batch of texts with one part after the
other; a worker holds ``HELD`` parts.

Defined results: null texts and texts without letters are ``und`` with score 0,
as is everything where nothing was learned; ties go to the alphabetically first
language; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.llm.text import batches, table
from isobar.session import fresh_name, materialize

DIMS, CENTROIDS, SAMPLE, PIECE, ROUNDS = 1 << 15, 3, 400, 1 << 20, 12
#: Languages of a part of the model, and parts that a worker holds.
PART, HELD = 64, 4
#: A cosine must reach this share of this quantile of the training texts' cosines.
SHARE, LOW = 0.7, 0.005
#: Letters in the beginnings of training texts that are scored too, and cosines that a class must have.
CUTS, LEAST = tuple(1 << k for k in range(1, 9)), 50
#: Languages whose counts are broadcast at most.
BROADCAST_LANGUAGES = 1_000_000
#: Classes by number of bins.
CLASSES = DIMS.bit_length() + 1
UND = "und"

_GAPS = re.compile(r"[\W\d_]+")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte n-grams that occur, in order, and how often each does."""
    out = None
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(f" {_GAPS.sub(' ', text[at : at + PIECE].lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
        two = raw[:-1] | raw[1:] << np.uint32(8)
        three = two[:-1] | raw[2:] << np.uint32(16)
        four = three[:-1] | raw[3:] << np.uint32(24)
        mixed = np.concatenate([two + np.uint32(2), three + np.uint32(3), four + np.uint32(4)]) * np.uint32(2654435761)
        bins = (mixed >> np.uint32(17)).astype(np.int64)
        if out is None and len(text) <= PIECE and len(bins) < DIMS // 8:
            return np.unique(bins, return_counts=True)
        found = np.bincount(bins, minlength=DIMS)
        out = found if out is None else out + found
    out = np.zeros(DIMS, np.int64) if out is None else out
    at = np.flatnonzero(out)
    return at, out[at]


def _weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF weights of bins and their counts."""
    w = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


def _beginnings(text: str) -> list[list[int]]:
    """The n-grams' bins, with repeats, of the text's first letters."""
    head = _GAPS.sub(" ", text[: 1 << 12].lower()).strip()
    return [np.repeat(*_counts(head[:k])).tolist() for k in CUTS if k < len(head)]


@dataclass
class Part:
    """By centroid a row of weights, a language and radii by class."""

    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray


def _read_part(path: str, part: int, otherwise: np.ndarray) -> Part:
    """A part of a fitted model from the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    held, where = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    rows = ds.dataset(where, filesystem=held, format="parquet").to_table(filter=ds.field("part") == part).sort_by("lang").to_pylist()
    centroids, langs, radius = [np.zeros((0, DIMS), np.float32)], [], []
    for r in rows:
        own = np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS)
        bound = np.array([o if x is None else x for x, o in zip(r["bounds"], otherwise.tolist(), strict=True)])
        centroids.append(own)
        langs += [r["lang"]] * len(own)
        radius += [1 - bound] * len(own)
    return Part(np.concatenate(centroids), langs, np.array(radius).reshape(-1, CLASSES))


@dataclass
class Model:
    """IDF, the folder of the parts, their number, and the bounds of languages of few texts."""

    idf: np.ndarray
    path: str
    parts: int
    otherwise: np.ndarray
    _held: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_held": {}}

    def part(self, i: int) -> Part:
        """Part ``i``; the one held longest gives way beyond ``HELD``."""
        if i not in self._held:
            while len(self._held) >= HELD:
                del self._held[next(iter(self._held))]
            self._held[i] = _read_part(self.path, i, self.otherwise)
        return self._held[i]

    @property
    def langs(self) -> list[str]:
        return [x for i in range(self.parts) for x in self.part(i).langs]

    @property
    def centroids(self) -> np.ndarray:
        return np.concatenate([self.part(i).centroids for i in range(self.parts)]) if self.parts else np.zeros((0, DIMS), np.float32)

    @property
    def radius(self) -> np.ndarray:
        return np.concatenate([self.part(i).radius for i in range(self.parts)]) if self.parts else np.zeros((0, CLASSES))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine with the nearest centroid and whether it is rejected, of each text."""
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        if not self.parts:
            return out
        asked = [(i, *_counts(t)) for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        asked = [(i, at, _weights(at, n, self.idf)) for i, at, n in asked]
        best = [-1.0] * len(texts)
        for k in range(self.parts):
            part = self.part(k)
            for i, at, w in asked if part.langs else ():
                cosine = part.centroids[:, at] @ w
                near = int(np.argmax(cosine))
                # The parts are in the order of their languages, so that of equal cosines the first stays.
                if cosine[near] > best[i]:
                    best[i] = float(cosine[near])
                    score = min(1.0, max(0.0, best[i]))
                    out[i] = part.langs[near], score, bool(1 - score > part.radius[near, len(at).bit_length()])
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are rows spread evenly over the closeness to the mean.

    (Farthest rows as first centres would leave clusters of one odd text each.)
    """
    order = np.argsort(rows @ rows.mean(axis=0), kind="stable")
    k = min(k, len(rows))
    centres = [rows[order[int((i + 0.5) / k * len(rows))]] for i in range(k)]
    found = np.stack(centres)
    for _ in range(ROUNDS):
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        own = np.argmax(rows @ found.T, axis=1)
        found = np.stack([rows[own == i].mean(axis=0) if (own == i).any() else found[i] for i in range(len(found))])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (doc_id, text, lang); lang isn't null, and texts without letters teach nothing.

    A language's task holds at most ``sample`` sparse count vectors with those
    of short beginnings.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    # A threshold on the hash takes a share of a language's rows first; the exact number is taken from those.
    share = F.least(F.lit(1.0), F.lit(3.0 * sample) / F.col("n"))
    small = counts.count() <= BROADCAST_LANGUAGES
    near = rows.join(F.broadcast(counts) if small else counts, "lang").withColumn("rank", F.xxhash64("doc_id"))
    near = near.where(F.col("rank") <= (F.lit(-(2.0**63)) + share * (2.0**64 - 2.0**12)).cast("long"))

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            texts = batch.column(2).to_pylist()
            found = [_counts(t) for t in texts]
            columns = [pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int64())), pa.array([_beginnings(t) for t in texts], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["lang", "rank", "at", "n", "short"])

    chosen = near.select("lang", "rank", "text").mapInArrow(run, "lang string, rank long, at array<int>, n array<long>, short array<array<int>>")
    order = Window.partitionBy("lang").orderBy("rank", F.xxhash64("at", "n"))
    held = materialize(chosen.withColumn("row", F.row_number().over(order)).where(F.col("row") <= sample), "language-sample")
    total = held.count()
    seen = np.zeros(DIMS)
    for r in held.select(F.explode("at").alias("bin")).groupBy("bin").count().collect():
        seen[r.bin] = r["count"]
    idf = np.log((1 + total) / (1 + seen)) + 1
    idf_held = labelled.sparkSession.sparkContext.broadcast(idf)

    def cluster(key, own):
        own = own.sort_values("row")
        centroids, bounds = fit_language(list(own["at"]), list(own["n"]), list(own["short"]), idf_held.value)
        return pd.DataFrame({"lang": [key[0]], "centroids": [centroids.astype(np.float32).tobytes()], "bounds": [bounds]})

    fitted = materialize(held.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, bounds array<double>"), "fitted-languages")
    # Parts are ranges of languages in order.
    parts = -(-fitted.count() // PART)
    if parts > 1:
        ranged = fitted.repartitionByRange(parts, "lang").withColumn("part", F.spark_partition_id())
        ranged = materialize(ranged, "language-parts")
        parts = ranged.agg(F.max("part")).first()[0] + 1
    else:
        ranged = materialize(fitted.withColumn("part", F.lit(0)), "language-parts")
    # A language of too few texts in all classes has the mean bounds of the others.
    means = {r.k: r.v for r in ranged.select(F.posexplode("bounds").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).collect()}
    return Model(idf, ranged.inputFiles()[0].rsplit("/", 1)[0] if parts else "", parts, np.array([means.get(k) or 0.0 for k in range(CLASSES)]))


def fit_language(at: list[np.ndarray], n: list[np.ndarray], short: list[list[np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, list[float | None]]:
    """Centroids of one language's sampled texts, and by class the least cosine of a text that is kept."""
    rows = np.zeros((len(at), DIMS), np.float32)
    for row, (bins, counts) in enumerate(zip(at, n, strict=True)):
        bins = np.asarray(bins, int)
        rows[row, bins] = _weights(bins, np.asarray(counts), idf)
    found: list[list[float]] = [[] for _ in range(CLASSES)]
    for fold in range(2) if len(at) > 1 else ():
        other = _clusters(rows[1 - fold :: 2], CENTROIDS)
        for row in range(fold, len(at), 2):
            texts = [(np.flatnonzero(rows[row]), None)] + [np.unique(np.asarray(x, int), return_counts=True) for x in short[row]]
            for bins, times in texts:
                w = rows[row, bins] if times is None else (1 + np.log(times)) * idf[bins]
                found[len(bins).bit_length()].append(float((other[:, bins] @ w).max() / np.linalg.norm(w)))
    return _clusters(rows, CENTROIDS), _bounds(found)


def _bounds(cosines: list[list[float]]) -> list[float | None]:
    """By class the least cosine of a text that is kept; a class of few cosines has that of the next shorter one, or else the next longer."""
    known = [k for k, x in enumerate(cosines) if len(x) >= LEAST]
    if not known:
        return [None] * CLASSES
    bound = {k: SHARE * float(np.quantile(cosines[k], LOW)) for k in known}
    return [bound[max((j for j in known if j <= k), default=known[0])] for k in range(CLASSES)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_tag, lang_pred, score, rejected.

    The model's IDF and the place of its parts are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            found = held.value.predict_all(batch.column(1).to_pylist())
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_tag", "lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, text_tag long, lang_pred string, score double, rejected boolean")


def held_out():
    """Rows that nothing is learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()))


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns.

    The text stays where it is: rows are filtered by an Arrow function of the
    text alone, in the scan's own partitions.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([not x[2] for x in held.value.predict_all(part.tolist())], dtype=bool)

    name = fresh_name(docs, "accepted")
    return docs.withColumn(name, accepted(F.col("text").cast("string"))).where(F.col(name)).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs, fit_documents(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
