"""Reading tables, and writing intermediate tables to the shared folder.

Intermediate results that are read more than once, or that end a long lineage,
are written as Parquet below the folder named by ``spark.checkpoint.dir``.  A
written table survives the loss of executors, and its size is known to the
planner, so a later join broadcasts it only if it is small enough.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH_KEY = "strandline.scratch.dir"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless PYTHONPATH already does."""
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("strandline.shipped", None):
        return
    archive = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("strandline.shipped", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system it lies."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs on one machine (a local master) a temporary folder
    is made; on a cluster a missing setting is an error.  The folder goes when the application ends.
    """
    known = spark.conf.get(_SCRATCH_KEY, None)
    if known:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="strandline-")
    path = f"{shared.rstrip('/')}/strandline-{uuid.uuid4().hex}"
    spark.conf.set(_SCRATCH_KEY, path)

    def clean() -> None:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may already be gone
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder, in folders by the column ``partition`` if one is given, and return it as read from there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._strandline_path = path
    return back


def release(*dfs: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_strandline_path", None)
        if path:
            delete_path(df.sparkSession, path)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows repeated whole count once, without a shuffle of the rows where there are few repeats.

    Only ``key`` is shuffled to find the values that occur more than once; rows of the
    other keys pass through, and the rows of repeated keys are made distinct.  Two rows
    that share a key but differ elsewhere both stay.  A null key counts as a value.
    """
    name = "_repeated"
    while name in df.columns:
        name += "_"
    counted = df.groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias(f"{name}n"))
    repeated = materialize(counted.filter(F.col(f"{name}n") > 1).select(name), "repeated")
    on = F.col(key).eqNullSafe(F.col(name))
    return df.join(repeated, on, "left_anti").unionByName(df.join(repeated, on, "left_semi").distinct())
