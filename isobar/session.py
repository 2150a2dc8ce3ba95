"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "isobar", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package, whatever folder they start in.

    On a cluster the package comes with ``--py-files`` or an environment.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master without such a setting (single-machine tests) a new
    temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-isobar-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Folders that this process has named, for ``forget``.
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other call gets."""
    _FOLDERS.append(f"{shared_dir(spark)}/isobar-{what}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder; how many.

    For a session's end: results that are still to be read depend on them.
    """
    return sum(delete(spark, _FOLDERS[-1]) for _ in range(len(_FOLDERS)))


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of ``new_folder`` that no result depends on; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    _FOLDERS.remove(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))  # noqa: SLF001


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage, so that a lost executor costs a re-read and not a
    recomputation, and gives later plans real sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def match(rows: DataFrame, keys: DataFrame, on: list[tuple[Column, str]], how: str = "left_semi") -> DataFrame:
    """Rows that have (``left_semi``) or don't have (``left_anti``) a partner in ``keys``.

    on: expressions over ``rows`` and the columns of ``keys`` that they equal,
    null being equal to null.  Names may clash: the keys get fresh ones.
    """
    names = [fresh_name(rows, f"match_{i}") for i in range(len(on))]
    side = keys.select(*[F.col(k).alias(n) for n, (_, k) in zip(names, on, strict=True)])
    test = F.lit(True)
    for n, (c, _) in zip(names, on, strict=True):
        test = test & c.eqNullSafe(F.col(n))
    return rows.join(side, test, how)
