"""A directory of tables, partitioned by repository: reading, schema growth, and publishing as a whole."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class Conflict(RuntimeError):
    """Another writer has published from the same version."""


class Files:
    """Small files in the store of the tables, through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted, without hidden ones."""
        fs, at = self._at(folder)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at)) if not n.startswith((".", "_"))) if fs.exists(at) else []

    def text(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; raises ``Conflict`` if it is there."""
        fs, at = self._at(path)
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as error:
            if fs.exists(at):
                raise Conflict(path) from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


class Catalogue:
    """Tables below a root folder, each in versions; a version becomes current when its marker is written, so readers see whole tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)
        self._seen: dict[str, int] = {}

    def _path(self, name: str) -> str:
        if not _NAME.fullmatch(name) or ".." in name:
            raise ValueError(f"bad table name {name!r}")
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """Numbers and ids of published versions, oldest first; a marker that is still being written is none."""
        folder = f"{self._path(name)}/versions"
        return [(int(n), version) for n in self.files.names(folder) if (version := self.files.text(f"{folder}/{n}"))]

    def current(self, name: str) -> str | None:
        """Where the newest published version is."""
        versions = self._versions(name)
        self._seen[name] = versions[-1][0] if versions else 0
        return f"{self._path(name)}/v-{versions[-1][1]}" if versions else None

    def publish(self, name: str, df: DataFrame, partition_by: str | None = "repo") -> None:
        """Write a new version beside the others; it becomes current when its marker, named by the next number, is there.

        The next number is that after the version which this catalogue read last. If another writer has taken it, this one gets ``Conflict``
        and its version is never seen; so no writer's work is lost unnoticed, and a reader finds either the version before or this one.
        """
        if name not in self._seen:
            self.current(name)
        number, version = self._seen[name] + 1, uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self._path(name)}/v-{version}")
        self.files.create(f"{self._path(name)}/versions/{number:012d}", version)
        self._seen[name] = number

    def expire(self, name: str, keep: int = 1) -> int:
        """Delete the rows of all but the ``keep`` newest versions; returns how many. No reader may be at work on older ones."""
        old = self._versions(name)[:-keep]
        held = [v for v in self.files.names(self._path(name)) if v.startswith("v-")]
        gone = [f"v-{v}" for _, v in old if f"v-{v}" in held]
        for v in gone:
            self.files.delete(f"{self._path(name)}/{v}")
        return len(gone)

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """The current version; columns of ``schema`` that it lacks are null."""
        path = self.current(name)
        if path is None:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(path)
        if schema is not None:
            for field in schema:
                if field.name not in df.columns:
                    df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
        return df


def shared_root(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or 'file://' + tempfile.gettempdir()).rstrip('/')}/loamstone/store-{uuid.uuid4().hex}"


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of files below a folder, recursively."""
    found = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content_hash, size_bytes) of files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"))
