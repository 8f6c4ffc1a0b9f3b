"""Published tables: every write makes a new version, and readers go by a pointer that is moved once the version is complete.

A table is a folder with `versions/<name>` and `pointers/<tag>`: small files, numbered, whose last one names the version that is read. A write that fails
leaves no pointer, so the version before stays readable; readers that have begun keep the files of theirs. Several tags may point at one version, which is
written once. Works with any file system of Spark that can create a file only if it isn't there; a store that makes files visible only when
they are whole is enough.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LATEST = "latest"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _pointers(spark: SparkSession, folder: str, tag: str) -> list[tuple[int, str]]:
    """(number, version) of a tag's pointers, in order. Their names say it all: nothing has to be read."""
    fs, target = _files(spark, f"{folder}/pointers/{tag}")
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n.split("-", 1)[0].isdigit())


def current(spark: SparkSession, folder: str, tag: str = LATEST) -> str | None:
    """The version that a tag points at."""
    found = _pointers(spark, folder, tag)
    return found[-1][1] if found else None


def point(spark: SparkSession, folder: str, version: str, *tags: str) -> None:
    """Moves tags to a version that is complete; pointing back at an older one undoes a publication."""
    fs, done = _files(spark, f"{folder}/versions/{version}/_SUCCESS")
    if not fs.exists(done):
        raise ValueError(f"version {version} of {folder} is not complete")
    for tag in tags or (LATEST,):
        number = max([0, *(n for n, _ in _pointers(spark, folder, tag))]) + 1
        _, target = _files(spark, f"{folder}/pointers/{tag}/{number:09d}-{version}")
        fs.create(target, False).close()


def publish(df: DataFrame, folder: str, *tags: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version (df's plan runs once) and moves the tags (`latest` if none is named) to it. Returns its name."""
    version = uuid.uuid4().hex
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/versions/{version}")
    point(df.sparkSession, folder, version, *tags)
    return version


def published(spark: SparkSession, folder: str, tag: str = LATEST, schema: StructType | None = None) -> DataFrame:
    """The version that a tag points at now; later publications don't change what this frame reads."""
    version = current(spark, folder, tag)
    if version is None:
        raise ValueError(f"nothing is published as {tag} in {folder}")
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/versions/{version}")


def prune(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes versions that are not among the last `keep` of any tag, and returns their names. Not for folders into which a write is going on."""
    fs, top = _files(spark, f"{folder}/versions")
    _, tags = _files(spark, f"{folder}/pointers")
    kept: set[str] = set()
    for status in fs.listStatus(tags) if fs.exists(tags) else []:
        kept |= {version for _, version in _pointers(spark, folder, status.getPath().getName())[-keep:]}
    gone = sorted(s.getPath().getName() for s in (fs.listStatus(top) if fs.exists(top) else []) if s.getPath().getName() not in kept)
    for version in gone:
        fs.delete(_files(spark, f"{folder}/versions/{version}")[1], True)
    return gone
