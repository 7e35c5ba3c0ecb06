"""A versioned index of chunks on files: versions are built aside and made current by one small write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.providers import EmbeddingProvider


class IndexStore:
    """Folders ``versions/<id>`` of parquet and numbered files in ``pointers``, the last of which names the one in use, under any file system of Spark.

    A version that fails to be written or checked never becomes current, so readers keep the one before.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        path, fs = self._fs(f"{self.root}/pointers")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def current(self) -> dict | None:
        names = self._pointers()
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{names[-1]}", wholetext=True).first()[0]) if names else None

    def rebuild(self, chunks: DataFrame, embedding: EmbeddingProvider, fingerprint: str) -> dict:
        """Embed and write ``chunk_id, text, ...``, check the vectors, and make the version current.

        A version of the same fingerprint that is current is kept as it is. Vectors have to be of one positive length
        and finite, one for each chunk.
        """
        now = self.current()
        if now and now["fingerprint"] == fingerprint:
            return now
        version = {"id": uuid.uuid4().hex, "fingerprint": fingerprint, "embedding": embedding.identity}
        folder = f"{self.root}/versions/{version['id']}"
        try:
            chunks.withColumn("embedding", embedding.column("text")).write.parquet(folder)
            bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
            seen = self.spark.read.parquet(folder).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"), F.count_distinct("chunk_id").alias("ids")).first()
            if not seen.n or seen.ids != seen.n or seen.a != seen.b or not seen.a or seen.bad:
                raise ValueError("vectors are missing, of several lengths or not finite")
        except Exception:
            path, fs = self._fs(folder)
            fs.delete(path, True)
            raise
        version["dimension"] = seen.a
        self._point_to(version)
        if now:
            path, fs = self._fs(f"{self.root}/versions/{now['id']}")
            fs.delete(path, True)
        return version

    def _point_to(self, version: dict) -> None:
        """Write the pointer aside and rename it into place under the next number; the highest number counts, so a reader
        finds the version before or this one at any time."""
        names = self._pointers()
        aside, fs = self._fs(f"{self.root}/aside-{version['id']}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        folder, _ = self._fs(f"{self.root}/pointers")
        fs.mkdirs(folder)
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        if not fs.rename(aside, self._fs(f"{self.root}/pointers/{number:012d}.json")[0]):
            raise OSError("the new version could not be made current")
        for name in names:
            fs.delete(self._fs(f"{self.root}/pointers/{name}")[0], False)

    def rows(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(f"{self.root}/versions/{now['id']}") if now else None
