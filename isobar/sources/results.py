"""Results of many models that survive a crash, preferred reads, and results kept as JSON."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.sources import sinks


def write_model(rows: DataFrame, root: str, model: str) -> None:
    """Replaces one model's rows; the folder counts from the moment its job is committed."""
    sinks.write_table(rows.drop("model"), f"{root}/model={quote(model, safe='')}", overwrite=True)


def manifest(spark: SparkSession, root: str) -> list[str]:
    """Models whose rows are there, sorted; half-written ones don't count."""
    return sorted(unquote(m) for m in sinks.committed(spark, root, "model"))


def run_models(spark: SparkSession, root: str, models: list[str], make: Callable[[str], DataFrame]) -> dict[str, str]:
    """Makes and writes the models that aren't there yet, one after the other; {model: error} of those that failed.

    A model that fails doesn't stop the others, and is tried again by the next run.
    """
    failed, have = {}, set(manifest(spark, root))
    for model in models:
        if model in have:
            continue
        try:
            write_model(make(model), root, model)
        except Exception as error:  # noqa: BLE001  what can go wrong with a model is not known here; the caller gets it
            failed[model] = f"{type(error).__name__}: {error}"
    return failed


def read_models(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """Rows of finished models with their name in ``model``; LookupError if there are none."""
    found = [m for m in manifest(spark, root) if models is None or m in models]
    if not found:
        raise LookupError(f"no finished model at {root}")
    paths = [f"{root}/model={quote(m, safe='')}" for m in found]
    return spark.read.option("basePath", root).parquet(*paths).withColumn("model", F.col("model").cast("string"))


def read_preferred(spark: SparkSession, root: str, stem: str, names: list[str] | None = None) -> DataFrame | None:
    """The full table ``stem``; with ``names`` for each the table ``stem_name`` or, where that isn't finished, ``stem_name_partial``.

    Column ``partial`` says which.  Names with neither are left out; None if nothing is there.
    """
    tables = []
    for path in [stem] if names is None else [f"{stem}_{n}" for n in names]:
        options = [path] if names is None else [path, f"{path}_partial"]
        held = next((p for p in options if sinks.exists(spark, f"{root}/{p}")), None)
        if held is not None:
            tables.append(spark.read.parquet(f"{root}/{held}").withColumn("partial", F.lit(held.endswith("_partial"))))
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def read_nested(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, value) of JSON files whose objects are nested as deep as ``keys``: {a: {b: number}}; what isn't a number is null."""
    kind = "double"
    for _ in keys:
        kind = f"map<string, {kind}>"
    out = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("_0"))
    for i, key in enumerate(keys):
        out = out.select(*keys[:i], F.explode(f"_{i}").alias(key, f"_{i + 1}"))
    return out.select(*keys, F.col(f"_{len(keys)}").alias("value"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, value) of JSON files {name: [numbers]}, i from 0."""
    held = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("name", "v"))
    return held.select("name", F.posexplode("v").alias("i", "value"))
