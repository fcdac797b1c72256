"""A store of results: each name has numbered versions, which can be listed, cleaned, restored and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Runs:
    """Versions are folders of Parquet files below ``folder``; one without a commit marker doesn't count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str, version: int | None = None) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"not a name of a run: {name!r}")
        return f"{self.folder}/{name}" + ("" if version is None else f"/v{version:06d}")

    def _children(self, place: str) -> list[str]:
        path = self._path(place)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def names(self) -> list[str]:
        return [x for x in self._children(self.folder) if self.versions(x)]

    def versions(self, name: str) -> list[int]:
        return [int(x[1:]) for x in self._children(self._place(name)) if x[:1] == "v" and self._fs.exists(self._path(f"{self._place(name)}/{x}/_SUCCESS"))]

    def save(self, name: str, rows: DataFrame) -> int:
        version = max(self.versions(name), default=0) + 1
        rows.write.mode("overwrite").parquet(self._place(name, version))
        return version

    def load(self, name: str, version: int | None = None) -> DataFrame:
        found = self.versions(name)
        if not found or version is not None and version not in found:
            raise KeyError(f"no version {version or ''} of {name}")
        return self.spark.read.parquet(self._place(name, version or found[-1]))

    def restore(self, name: str, version: int) -> int:
        """An older version as the newest one."""
        return self.save(name, self.load(name, version))

    def clean(self, name: str, keep: int = 1) -> list[int]:
        """Deletes all but the newest versions; those that are gone."""
        gone = self.versions(name)[:-keep] if keep else self.versions(name)
        for v in gone:
            self._fs.delete(self._path(self._place(name, v)), True)
        return gone

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self._place(name)), True)

    def where(self, matches) -> dict[str, DataFrame]:
        """The newest version of every name that ``matches(name)``."""
        return {x: self.load(x) for x in self.names() if matches(x)}

    def memoised(self, name: str, make) -> DataFrame:
        """The newest version, made and saved if there is none."""
        if not self.versions(name):
            self.save(name, make())
        return self.load(name)


def write_steps(rows: DataFrame, folder: str, step: str) -> None:
    """Results as JSON lines, a folder for each step."""
    rows.withColumn("_step", F.col(step)).write.mode("overwrite").partitionBy("_step").json(folder)
