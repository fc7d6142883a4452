"""Files as tables, and tables as files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of media files, in any case.
MEDIA_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "flv", "wmv", "mpg", "mpeg")


def find_media(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Media files below ``path`` with size and time of change; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(suffix.isin(*MEDIA_SUFFIXES)).select("path", "length", "modificationTime").orderBy("path")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one object each; a broken file or one that holds no object gives nulls."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o")).select("o.*")


def read_list(df: DataFrame, column: str, element: str) -> DataFrame:
    """One row for each element of a JSON list; anything else gives no rows."""
    return df.select(F.explode(F.from_json(F.col(column), f"ARRAY<{element}>")).alias("element"))


def checksum(files: DataFrame) -> DataFrame:
    """SHA-256 of ``binaryFile`` contents."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def signature(pairs: dict[str, object], leave_out: tuple[str, ...] = ()) -> Column:
    """SHA-256 over the sorted pairs of a configuration."""
    rows = sorted((k, str(v)) for k, v in pairs.items() if k not in leave_out)
    return F.sha2(F.lit("\n".join(f"{k}={v}" for k, v in rows)), 256)


def write_sidecar(df: DataFrame, path: str, columns: tuple[str, ...] = ("license", "author", "page_url")) -> bool:
    """A tab-separated file of attributions, only if any row has one."""
    some = F.bool_or(F.greatest(*[F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False)) for c in columns]))
    if not df.agg(some.alias("x")).head()["x"]:
        return False
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return True


def write_blobs(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """Write each row's bytes to ``folder``/``name`` from the executors, each file whole or not at all.

    ``folder`` is one that all executors share.  Gives the names and sizes written.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for file, data in zip(batch[name], batch[content]):
                target = os.path.join(folder, os.path.basename(file))
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, target)
                sizes.append(len(data))
            yield pd.DataFrame({"name": batch[name], "size": sizes})

    return df.filter(F.col(name).isNotNull() & F.col(content).isNotNull()).select(name, content).mapInPandas(write, "name string, size bigint")
