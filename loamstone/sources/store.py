"""Tables in hash buckets that change together: a commit rewrites or extends only the buckets of changed keys, in any number of tables.

Rows go to new folders first; a commit becomes visible when its marker file, named by the next number, is created. Creation
fails if the number is taken, so of two writers that start from one version the second is told (``Conflict``) and nothing is
lost. The manifest that a marker names lists, per table and bucket, the folders that make it up, and the last batch of every
stream that has been taken in, so that a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import Conflict, Files

BUCKETS = 64
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
_BUCKET = "bucket"


class Store:
    """Named tables below a root folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)

    def version(self) -> int:
        """The number of the newest commit, 0 if there is none."""
        return self._newest()[0]

    def _newest(self) -> tuple[int, dict]:
        for name in reversed(self.files.names(f"{self.root}/log")):
            if manifest := self.files.text(f"{self.root}/log/{name}"):
                return int(name), json.loads(self.files.text(f"{self.root}/manifests/{manifest}"))
        return 0, {"tables": {}, "done": {}}

    def tables(self) -> list[str]:
        return sorted(self._newest()[1]["tables"])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of now, or some buckets of it; files of other buckets are not listed, let alone read."""
        return self._read(self._newest()[1], name, buckets)

    def _read(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        table = manifest["tables"].get(name)
        if table is None:
            raise FileNotFoundError(name)
        schema = StructType.fromJson(table["schema"])
        wanted = table["parts"] if buckets is None else {str(b): table["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.root}/data/{name}/commit={c}/{_BUCKET}={b}" for b, commits in wanted.items() for c in commits]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str, *key: Column) -> Column:
        """The bucket of a key of a table."""
        return _bucket(self._newest()[1]["tables"][name]["buckets"], *key)

    def begin(self) -> Change:
        """A change of the version that is newest now."""
        return Change(self)

    def expire(self, keep: int = 1) -> int:
        """Delete rows that none of the ``keep`` newest commits names; returns how many folders went. No reader or writer may be at work on older ones."""
        names = [n for n in self.files.names(f"{self.root}/log") if self.files.text(f"{self.root}/log/{n}")]
        held = set()
        for n in names[-keep:]:
            for table, t in json.loads(self.files.text(f"{self.root}/manifests/{self.files.text(f'{self.root}/log/{n}')}"))["tables"].items():
                held |= {(table, c, b) for b, commits in t["parts"].items() for c in commits}
        gone = 0
        for table in self.files.names(f"{self.root}/data"):
            for commit in self.files.names(f"{self.root}/data/{table}"):
                for bucket in self.files.names(f"{self.root}/data/{table}/{commit}"):
                    if bucket.startswith(f"{_BUCKET}=") and (table, commit.split("=")[1], bucket.split("=")[1]) not in held:
                        self.files.delete(f"{self.root}/data/{table}/{commit}/{bucket}")
                        gone += 1
        return gone


def _bucket(buckets: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class Change:
    """Work on one version of a store. Nothing of it is seen before ``commit``."""

    def __init__(self, store: Store):
        self.store = store
        self.base, self.manifest = store._newest()
        self.id = uuid.uuid4().hex
        self.written: dict[str, list[int]] = {}

    def done(self, stream: str, batch: int) -> bool:
        """Whether a commit took this batch of a stream in."""
        return self.manifest["done"].get(stream, -1) >= batch

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the version that this change starts from."""
        return self.store._read(self.manifest, name, buckets)

    def declare(self, name: str, schema: StructType | str, key: list[str], buckets: int = BUCKETS) -> None:
        """A new table without rows, or a new start of one."""
        if not _NAME.fullmatch(name):
            raise ValueError(f"bad table name {name!r}")
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.manifest["tables"][name] = {"key": key, "buckets": buckets, "schema": schema.jsonValue(), "parts": {}}

    def create(self, name: str, df: DataFrame, key: list[str], buckets: int = BUCKETS, gather: bool = True) -> None:
        """A new table with these rows, or a new start of one."""
        self.declare(name, df.schema, key, buckets)
        self._write(name, df, keep=True, gather=gather)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of the keys, a row for each bucket at most."""
        table = self.manifest["tables"][name]
        found = keys.select(_bucket(table["buckets"], *[F.col(k) for k in table["key"]]).alias(_BUCKET)).distinct()
        return sorted(r[0] for r in found.collect())

    def rewrite(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put ``change(rows)`` in place of the rows of all buckets that hold one of the keys; returns these buckets.

        ``change`` gets whole buckets and must return what stays of them; it may add rows of touched buckets only."""
        buckets = self.touched(name, keys)
        if buckets:
            df = change(self.read(name, buckets))
            for b in buckets:
                self.manifest["tables"][name]["parts"].pop(str(b), None)
            self._write(name, df, keep=False)
        return buckets

    def append(self, name: str, df: DataFrame, gather: bool = True) -> None:
        """Add rows; what the buckets hold stays where it is."""
        self._write(name, df, keep=True, gather=gather)

    def _write(self, name: str, df: DataFrame, keep: bool, gather: bool = True) -> None:
        """With ``gather``, rows of a bucket are shuffled together; without, each task of ``df`` writes a file to every bucket that it has rows of,
        which saves the shuffle where tasks hold many rows."""
        table = self.manifest["tables"][name]
        schema = StructType.fromJson(table["schema"])
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], _bucket(table["buckets"], *[F.col(k) for k in table["key"]]).alias(_BUCKET))
        part = f"{self.id}{len(self.written.get(name, []))}"
        folder = f"{self.store.root}/data/{name}/commit={part}"
        (rows.hint("rebalance", _BUCKET) if gather else rows).sortWithinPartitions(_BUCKET, *table["key"]).write.option("compression", "zstd").partitionBy(_BUCKET).parquet(folder)
        for found in self.store.files.names(folder):
            if found.startswith(f"{_BUCKET}="):
                commits = table["parts"].setdefault(found.split("=")[1], [])
                commits[:] = [*commits, part] if keep else [part]
        self.written.setdefault(name, []).append(part)

    def commit(self, stream: str | None = None, batch: int | None = None) -> int:
        """Make the change visible as a whole; raises ``Conflict`` if another commit came first."""
        if stream is not None:
            self.manifest["done"][stream] = batch
        files, number = self.store.files, self.base + 1
        files.create(f"{self.store.root}/manifests/{self.id}.json", json.dumps(self.manifest))
        files.create(f"{self.store.root}/log/{number:012d}", f"{self.id}.json")
        return number


__all__ = ["BUCKETS", "Change", "Conflict", "Store"]
