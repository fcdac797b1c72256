"""Readers and writers of events, edge lists and graphs.

Events are (seq, src, dest, ts, op, attrs). A path is one file; ``seq`` ascends in its line order and isn't dense.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.order import with_position


def _adds(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "src", "dest", "ts", F.lit("ADD").alias("op"), F.lit(None).cast("map<string,string>").alias("attrs"))


def event_text(spark: SparkSession, path: str) -> DataFrame:
    """``src dest ts`` lines without header; every event adds. Malformed lines raise."""
    rows = spark.read.csv(path, sep=" ", schema="src long, dest long, ts long", mode="FAILFAST")
    return _adds(rows.withColumn("seq", F.monotonically_increasing_id()))


def event_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header line in each file, then ``src,dest,timestamp,type[,key=value...]``; the tail is ragged, so lines are cut here.

    A line of fewer than four fields, or with one that isn't a number where one has to be, raises.
    """
    lines = spark.read.csv(path, sep="\u0001", schema="value string", header=True, quote="", mode="FAILFAST")
    rows = lines.select(F.monotonically_increasing_id().alias("seq"), F.split("value", ",").alias("p"))
    short = F.raise_error(F.concat(F.lit("fewer than four fields: "), F.concat_ws(",", "p"))).cast("array<string>")
    rows = rows.withColumn("p", F.when(F.size("p") < 4, short).otherwise(F.col("p")))
    attrs = F.when(F.size("p") > 4, F.str_to_map(F.concat_ws(",", F.slice("p", 5, F.size("p") - 4)), F.lit(","), F.lit("=")))
    number = [F.trim(F.col("p")[k]).cast("long").alias(c) for k, c in enumerate(("src", "dest", "ts"))]
    return rows.select("seq", *number, F.upper(F.trim(F.col("p")[3])).alias("op"), attrs.alias("attrs"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            raw = data.as_buffer()
            if raw.size % 12:
                raise ValueError(f"{raw.size % 12} bytes after the last whole record")
            x = np.frombuffer(raw, "<i4").reshape(-1, 3).astype(np.int64)
            for at in range(0, len(x), 65_536):
                own = x[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(own))), *[pa.array(np.ascontiguousarray(own[:, k])) for k in range(3)]], names=["seq", "src", "dest", "ts"])


def event_binary(spark: SparkSession, path: str) -> DataFrame:
    """12-byte little-endian records of three 32-bit integers. A file is read by one task, so it must stay below 2 GB."""
    return _adds(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records, "seq long, src long, dest long, ts long"))


def _csr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            with np.load(io.BytesIO(data)) as z:
                per = np.diff(z["adj_indptr"])
                row, col = np.repeat(np.arange(len(per)), per), z["adj_indices"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col)], names=["src", "dest"])


def npz_edges(spark: SparkSession, path: str) -> DataFrame:
    """Canonical edges of a compressed sparse row matrix; both triangles name the same edge."""
    return graph.canonical(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_csr, "src long, dest long"))


def npz_events(spark: SparkSession, path: str) -> DataFrame:
    """The matrix's edges in ascending order as events, numbered from 0."""
    e = with_position(npz_edges(spark, path).withColumn("at", F.col("u") * 2147483648 + F.col("v")), "at", "seq")
    return _adds(e.select("seq", F.col("u").alias("src"), F.col("v").alias("dest"), F.col("seq").alias("ts")))


def edge_list(spark: SparkSession, path: str, sep: str = "\t", skip: int = 0, limit: int | None = None) -> DataFrame:
    """src, dest of lines ``skip`` to ``limit`` (an absolute end line); lines starting with # are passed over."""
    lines = with_position(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), "at")
    kept = lines.where((F.col("pos") >= skip) & (F.lit(True) if limit is None else F.col("pos") < limit) & ~F.col("value").startswith("#"))
    p = F.split("value", "\\Q" + sep + "\\E")
    return kept.select(F.trim(p[0]).cast("long").alias("src"), F.trim(p[1]).cast("long").alias("dest"))


def edge_json(spark: SparkSession, path: str, dotted: str = "") -> DataFrame:
    """src, dest of the array of pairs at a dotted path of one JSON document."""
    at = F.get_json_object("value", "$" + "".join(f".{k}" for k in dotted.split(".") if k)) if dotted else F.col("value")
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(at, "array<array<string>>")).alias("p"))
    return pairs.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dest"))


_TOKEN = re.compile(r'\[|\]|"[^"]*"|[^\s\[\]"]+')


def _gml_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, a, b of the nodes (id, label) and edges (source, target) directly inside a graph; blocks within them are passed over."""
    named = {"node": ("id", "label"), "edge": ("source", "target")}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            out, stack, key = [], [], None
            for line in io.StringIO(text):
                if line.lstrip().startswith("#"):
                    continue
                for token in _TOKEN.findall(line):
                    if token == "[":
                        stack.append((key, {}))
                        key = None
                    elif token == "]":
                        if not stack or key is not None:
                            raise ValueError("brackets or values don't match")
                        kind, own = stack.pop()
                        if kind in named and stack and stack[-1][0] == "graph":
                            out.append((kind, *(own.get(k) for k in named[kind])))
                    elif key is None:
                        key = token
                    else:
                        if stack:
                            stack[-1][1][key] = token.strip('"')
                        key = None
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["kind", "a", "b"])
                    out = []
            if stack:
                raise ValueError("a block isn't closed")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["kind", "a", "b"])


def gml(spark: SparkSession, path: str, by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """vertices(id) and canonical edges(u, v) of a GML file with integer ids.

    Vertices are named by their labels, by their ids where they have none or with ``by_id``; a label that isn't an
    integer raises. Blocks may nest and stand on one line; a quoted value doesn't span lines. A file is read by one task.
    """
    found = spark.read.text(path, wholetext=True).mapInArrow(_gml_blocks, "kind string, a string, b string")
    label = F.lit(None).cast("long") if by_id else F.col("b").cast("long")
    nodes = found.where("kind = 'node'").select(F.col("a").cast("long").alias("node"), label.alias("label"))
    ends = found.where("kind = 'edge'").select(F.col("a").cast("long").alias("s"), F.col("b").cast("long").alias("t"))
    nodes = nodes.select("node", F.coalesce("label", "node").alias("id"))
    named = ends.join(nodes.select(F.col("node").alias("s"), F.col("id").alias("src")), "s").join(nodes.select(F.col("node").alias("t"), F.col("id").alias("dest")), "t")
    return nodes.select("id"), graph.canonical(named)


def write_event_text(events: DataFrame, path: str) -> None:
    """A folder of ``src dest ts`` lines in seq order over its part files; op and attrs have no place in this format."""
    events.repartitionByRange("seq").sortWithinPartitions("seq").select("src", "dest", "ts").write.mode("overwrite").csv(path, sep=" ")


def write_gml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder whose part files, read in order, are one GML document."""
    lines = vertices.select(F.lit(1).alias("k"), F.format_string('  node [ id %d label "%d" ]', "id", "id").alias("value"))
    lines = lines.unionByName(edges.select(F.lit(2).alias("k"), F.format_string("  edge [ source %d target %d ]", "u", "v").alias("value")))
    lines = lines.unionByName(vertices.sparkSession.createDataFrame([(0, "graph ["), (3, "]")], "k int, value string"))
    lines.repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def write_event_binary(events: DataFrame, path: str) -> None:
    """A folder of files of three native int32 each event (src, dest, ts); read by name, they are in seq order.

    A task writes to a name of its own and moves it into place, so a task that runs again leaves one file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}.bin"
        own, rows = f"{folder}/_{context.taskAttemptId()}", 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                block = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
                if block.size and (block.max() > 2147483647 or block.min() < -2147483648):
                    raise ValueError("this format holds 32-bit values")
                out.write(block.astype("=i4").tobytes())
                rows += batch.num_rows
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    ordered = events.repartitionByRange("seq").sortWithinPartitions("seq").select(*[F.col(c).cast("long") for c in ("src", "dest", "ts")])
    ordered.mapInArrow(put, "rows long").agg(F.sum("rows")).collect()
