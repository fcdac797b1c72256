"""Named datasets and graphs made by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generators, graph


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))


def cycle_graph(spark: SparkSession, n: int) -> DataFrame:
    return graph.canonical(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dest")))


def star_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("v"))


#: Graphs by name: f(spark, *sizes) -> edges(u, v).
GRAPHS: dict[str, Callable[..., DataFrame]] = {
    "path": path_graph,
    "cycle": cycle_graph,
    "star": star_graph,
    "complete": complete_graph,
    "planted_partition": generators.planted_partition,
}


class Registry:
    """Datasets by name, each a function of the session with parameters that a call may override."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[Callable[..., DataFrame], dict]] = {}

    def register(self, name: str, make: Callable[..., DataFrame], **parameters) -> None:
        self._found[name] = (make, parameters)

    def names(self) -> list[str]:
        return sorted(self._found)

    def load(self, spark: SparkSession, name: str, **overrides) -> DataFrame:
        if name not in self._found:
            raise KeyError(f"no dataset {name}; there are {', '.join(self.names())}")
        make, parameters = self._found[name]
        return make(spark, **(parameters | overrides))

    def external(self, name: str, place: str, form: str = "parquet") -> None:
        """A table in another folder, read where it is."""
        self.register(name, lambda spark, **options: spark.read.format(form).options(**options).load(place))


def listed(spark: SparkSession, place: str) -> list[str]:
    """The paths that a list file names, one a line; # begins a comment. The list comes to the driver."""
    lines = spark.read.text(place).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("p")).where("p <> ''")
    return [r["p"] for r in lines.collect()]


def from_iterable(spark: SparkSession, rows, batch: int = 10_000) -> DataFrame:
    """Events (src, dest, ts) of a driver's iterable, in its order."""
    out, held, seq = None, [], 0
    for src, dest, ts in rows:
        held.append((seq, src, dest, ts, "ADD", None))
        seq += 1
        if len(held) == batch:
            part = spark.createDataFrame(held, "seq long, src long, dest long, ts long, op string, attrs map<string,string>")
            out, held = part if out is None else out.unionByName(part), []
    part = spark.createDataFrame(held, "seq long, src long, dest long, ts long, op string, attrs map<string,string>")
    return part if out is None else out.unionByName(part)
