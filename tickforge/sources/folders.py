"""Folders that hold a table in parts, and small files that say which parts count."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.operators.text import chunk_upsert


class Folder:
    """A folder of any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self._files.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, name: str) -> list[str]:
        store, folder = self._at(name)
        return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []

    def touch(self, name: str) -> None:
        store, path = self._at(name)
        store.create(path, True).close()

    def delete(self, name: str) -> None:
        store, path = self._at(name)
        store.delete(path, True)


class Snapshots(Folder):
    """Numbered folders, of which the finished ones have an empty file with their number.

    A batch builds its version from the one before it and marks it when all is written, so that
    readers never see half of it, and a repeated batch starts from the same predecessor. ``keep``
    versions stay, all of them with None. A mark also holds a time, which makes it possible to
    read the version that was current then.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int | None = 2):
        super().__init__(spark, path)
        self.keep = keep

    def finished(self) -> dict[int, int]:
        """The time of each finished version that is still there, in microseconds, in order of versions."""
        return dict(tuple(map(int, name.split("-"))) for name in self.names("current"))

    def folder(self, version: int) -> str:
        return f"{self.path}/snapshot/{version}"

    def before(self, batch: int) -> int | None:
        """The version that a batch starts from."""
        return max((v for v in self.finished() if v < batch), default=None)

    def current(self, until_us: int | None = None) -> int | None:
        """The newest version, or the newest whose time is not after ``until_us``."""
        return max((v for v, us in self.finished().items() if until_us is None or us <= until_us), default=None)

    def finish(self, version: int, us: int = 0) -> None:
        self.touch(f"current/{version:020d}-{max(0, us):020d}")
        for old, old_us in list(self.finished().items())[: -self.keep if self.keep else 0]:
            self.delete(f"current/{old:020d}-{old_us:020d}")
            self.delete(f"snapshot/{old}")


class RunTable(Folder):
    """A table to which every run adds its rows once: a run that is repeated replaces its own.

    Each attempt of a run has a folder, and an empty file in ``commits`` makes it the run's rows. The
    attempt before it goes afterwards, so that readers see one of the two, whole.
    """

    def _attempts(self) -> dict[str, int]:
        """The newest committed attempt of each run."""
        marks = [name.rsplit("@", 1) for name in self.names("commits")]
        return {run: max(int(n) for r, n in marks if r == run) for run, _ in marks}

    def write(self, rows: DataFrame, run_id: str) -> None:
        run = quote(run_id, safe="")
        known = self._attempts().get(run)
        attempt = 0 if known is None else known + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/runs/{run}/{attempt}")
        self.touch(f"commits/{run}@{attempt:010d}")
        if known is not None:
            self.delete(f"commits/{run}@{known:010d}")
            self.delete(f"runs/{run}/{known}")

    def read(self) -> DataFrame:
        """The rows of all runs; columns that some of them lack are null there."""
        paths = [f"{self.path}/runs/{run}/{n}" for run, n in self._attempts().items()]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)


class BucketedIndex(Snapshots):
    """Chunks in hash buckets of their document. An upsert rewrites the buckets that it touches.

    A version is a list of (bucket, generation), the generation being the version that wrote the
    bucket's folder. Marking the version swaps the list, so readers see all of an upsert or nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path)
        self.buckets = buckets

    def _places(self, version: int | None) -> dict[int, int]:
        """The generation of each bucket; as many rows as there are buckets."""
        if version is None:
            return {}
        return {r.bucket: r.generation for r in self.spark.read.parquet(self.folder(version)).collect()}

    def _paths(self, places: dict[int, int]) -> list[str]:
        return [f"{self.path}/buckets/generation={g}/bucket={b}" for b, g in sorted(places.items())]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self._paths(self._places(self.current())))

    def upsert(self, chunks: DataFrame) -> list[int]:
        """Put chunks in place of those with the same URI and number; the buckets that were written."""
        current = self.current()
        version, places = (0 if current is None else current + 1), self._places(current)
        dealt = chunks.withColumn("bucket", F.pmod(F.xxhash64("source_uri"), F.lit(self.buckets)).cast("int"))
        # Chunks are made once: their folders tell which buckets they touch, and are those of the version if nothing is there to merge.
        target = f"buckets/generation={version}"
        sent = f"sent/{version}" if places else target
        self._put(dealt, sent)
        touched = sorted(int(name.split("=")[1]) for name in self.names(sent) if name.startswith("bucket="))
        if not touched:
            self.delete(sent)
            return []
        if places:
            merged, old = self.spark.read.schema(dealt.schema).parquet(f"{self.path}/{sent}"), {b: places[b] for b in touched if b in places}
            if old:
                known = self.spark.read.parquet(*self._paths(old)).withColumn("bucket", F.pmod(F.xxhash64("source_uri"), F.lit(self.buckets)).cast("int"))
                merged = chunk_upsert(known, merged)
            self._put(merged, target)
            self.delete(sent)
        places |= dict.fromkeys(touched, version)
        self.spark.createDataFrame(sorted(places.items()), "bucket int, generation int").coalesce(1).write.mode("overwrite").parquet(self.folder(version))
        self.finish(version)
        self._drop_unused()
        return touched

    def _put(self, chunks: DataFrame, name: str) -> None:
        writer = chunks.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _drop_unused(self) -> None:
        """Folders that no version names any more."""
        used = {place for v in self.finished() for place in self._places(v).items()}
        for generation in self.names("buckets"):
            g = int(generation.split("=")[1])
            for bucket in self.names(f"buckets/{generation}"):
                if bucket.startswith("bucket=") and (int(bucket.split("=")[1]), g) not in used:
                    self.delete(f"buckets/{generation}/{bucket}")
