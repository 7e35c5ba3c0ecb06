"""Tables on files that change as a whole: written aside, then made current by the rename of one small manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NothingDeleted(LookupError):
    """A deletion that met no row."""


class TableStore:
    """Named tables under ``root`` on any file system of Spark, as lists of parquet folders named by the newest manifest.

    Readers see the tables of one manifest. What a transaction writes counts once its manifest is renamed into place, for all
    its tables at once; if it ends in an error its folders are removed and nothing changes. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[str]:
        path, fs = self._at("manifests")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> dict[str, list[str]]:
        names = self._numbers()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0]) if names else {}

    def read(self, name: str) -> DataFrame | None:
        folders = self.manifest().get(name)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        tx = Transaction(self)
        try:
            yield tx
        except BaseException:
            for folder in tx.made:
                path, fs = self._at(folder)
                fs.delete(path, True)
            raise
        if tx.tables != tx.before:
            self._publish(tx.tables)
            for folder in {f for fs_ in tx.before.values() for f in fs_} - {f for fs_ in tx.tables.values() for f in fs_}:
                path, fs = self._at(folder)
                fs.delete(path, True)

    def _publish(self, tables: dict[str, list[str]]) -> None:
        names = self._numbers()
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        aside, fs = self._at(f"aside-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        fs.mkdirs(self._at("manifests")[0])
        if not fs.rename(aside, self._at(f"manifests/{number:012d}.json")[0]):
            raise OSError("the manifest could not be put in place")
        for name in names:
            fs.delete(self._at(f"manifests/{name}")[0], False)


class Transaction:
    """Changes of a store's tables that become visible together."""

    def __init__(self, store: TableStore) -> None:
        self.store, self.before = store, store.manifest()
        self.tables = {k: list(v) for k, v in self.before.items()}
        self.made: list[str] = []

    def read(self, name: str) -> DataFrame | None:
        folders = self.tables.get(name)
        return self.store.spark.read.parquet(*[f"{self.store.root}/{f}" for f in folders]) if folders else None

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        self.made.append(folder)
        df.write.parquet(f"{self.store.root}/{folder}")
        return folder

    def rewrite(self, name: str, df: DataFrame) -> None:
        """The whole table becomes ``df``."""
        self.tables[name] = [self._write(name, df)]

    def append(self, name: str, df: DataFrame, key: str) -> None:
        """Rows whose key the table does not have, each key once; the files there stay as they are."""
        old, new = self.read(name), df.dropDuplicates([key])
        if old is not None:
            new = new.join(old.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
        self.tables.setdefault(name, []).append(self._write(name, new))

    def upsert(self, name: str, rows: DataFrame, keys: list[str], now: str) -> None:
        """Rows replace those of their keys and keep their ``created_at``; ``updated_at`` becomes the column ``now`` or, if that
        isn't later, the old stamp and a microsecond."""
        old = self.read(name)
        new = rows.withColumnRenamed(now, "__now")
        if old is None:
            self.rewrite(name, new.withColumns({"created_at": F.col("__now"), "updated_at": F.col("__now")}).drop("__now"))
            return
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        stamps = old.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("created_at").alias("__created"), F.col("updated_at").alias("__updated"))
        kept = new.join(stamps, same, "left").withColumns({
            "created_at": F.coalesce("__created", "__now"),
            "updated_at": F.greatest("__now", F.col("__updated") + F.expr("INTERVAL 0.000001 SECOND")),
        })
        incoming = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
        self.rewrite(name, old.join(incoming, same, "left_anti").unionByName(kept.select(*old.columns)))

    def replace(self, name: str, part: str, rows: DataFrame) -> None:
        """Rows of the parts that ``rows`` has give way to it."""
        old = self.read(name)
        if old is not None:
            parts = rows.select(F.col(part).alias("__p")).distinct()
            rows = old.join(parts, F.col(part) == F.col("__p"), "left_anti").unionByName(rows)
        self.rewrite(name, rows)

    def delete(self, name: str, column: str, values: DataFrame) -> int:
        """Remove the rows whose column is among ``values`` and count them; without such a row the table is left alone."""
        old = self.read(name)
        if old is None:
            return 0
        gone = values.select(F.col(values.columns[0]).alias("__v")).distinct()
        n = old.join(gone, F.col(column) == F.col("__v"), "left_semi").count()
        if n:
            self.rewrite(name, old.join(gone, F.col(column) == F.col("__v"), "left_anti"))
        return n

    def cascade(self, links: list[tuple[str, str]], values: DataFrame) -> dict[str, int]:
        """Delete from every ``(table, column)``; an error if no table had such a row."""
        counts = {name: self.delete(name, column, values) for name, column in links}
        if not any(counts.values()):
            raise NothingDeleted("no row with these keys")
        return counts

    def drop(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None
