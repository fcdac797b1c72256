"""What a user may add: other implementations of named functions, listeners, algorithms and settings."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class Conflict(RuntimeError):
    """Several implementations answered the same call."""


class Metric(Protocol):
    """A distance or similarity of two vector columns."""

    def __call__(self, a: Column, b: Column) -> Column: ...


class Assignment(Protocol):
    """assign(vertex, part) of a graph's edges(u, v)."""

    def __call__(self, edges: DataFrame, parts: int) -> DataFrame: ...


class Embedding(Protocol):
    """emb(vertex, vec) of a graph's edges(u, v)."""

    def __call__(self, edges: DataFrame, **options) -> DataFrame: ...


class Extensions:
    """Implementations and listeners by name.

    A call of a function marked ``pluggable`` asks every implementation given under its name. One answer other than
    None replaces the function's own; several raise Conflict; without any, the function runs itself.
    """

    def __init__(self) -> None:
        self._instead: dict[str, list[Callable]] = {}
        self._listeners: dict[str, list[Callable]] = {}

    def instead(self, name: str, f: Callable) -> None:
        self._instead.setdefault(name, []).append(f)

    def pluggable(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **named):
            answers = [x for x in (g(*args, **named) for g in self._instead.get(f.__name__, ())) if x is not None]
            if len(answers) > 1:
                raise Conflict(f"{len(answers)} implementations of {f.__name__} answer")
            return answers[0] if answers else f(*args, **named)

        return call

    def on(self, event: str, f: Callable) -> None:
        self._listeners.setdefault(event, []).append(f)

    def notify(self, event: str, **facts) -> int:
        """Calls the event's listeners in the order they came; how many there were. Their errors are the caller's."""
        called = self._listeners.get(event, [])
        for f in [*called]:
            f(**facts)
        return len(called)


class Algorithms:
    """Embedding algorithms by name, with options that a call may override."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[Embedding, dict]] = {}

    def register(self, name: str, f: Embedding, **options) -> None:
        if name in self._found:
            raise ValueError(f"there is an algorithm {name}")
        self._found[name] = (f, options)

    def names(self) -> list[str]:
        return sorted(self._found)

    def run(self, name: str, edges: DataFrame, **options) -> DataFrame:
        if name not in self._found:
            raise KeyError(f"no algorithm {name}; there are {', '.join(self.names())}")
        f, given = self._found[name]
        return f(edges, **(given | options))


def algorithms() -> Algorithms:
    """Those of this library: node2vec on the whole graph, entropy-stopped walks, and vectors that know nothing."""
    from pyspark.sql import functions as F

    from ..operators import graph, reports, walks
    from ..streaming import embeddings

    def one_part(edges: DataFrame, **options) -> DataFrame:
        whole = graph.vertices(edges).select(F.col("id").alias("vertex"), F.lit(0).alias("part"))
        return walks.node2vec(edges, whole, **options).select("vertex", "vec")

    def unlearned(edges: DataFrame, dim: int = 32, seed: int = 7) -> DataFrame:
        return reports.fresh_rows(graph.vertices(edges), dim, seed).withColumnRenamed("id", "vertex")

    out = Algorithms()
    out.register("node2vec", one_part)
    out.register("entropy", lambda edges, **options: embeddings.entropy_embed(edges, **options).select("vertex", "vec"))
    out.register("unlearned", unlearned)
    return out


@dataclass(frozen=True)
class Settings:
    """What a run may set; kept in the session's configuration, so that every part of a program sees the same."""

    parts: int = 8
    dim: int = 32
    walks: int = 10
    length: int = 10
    seed: int = 7

    def with_(self, **changed) -> Settings:
        return replace(self, **changed)

    def save(self, spark: SparkSession) -> None:
        for f in fields(self):
            spark.conf.set(f"graphloom.{f.name}", str(getattr(self, f.name)))

    @classmethod
    def load(cls, spark: SparkSession) -> Settings:
        found = {f.name: spark.conf.get(f"graphloom.{f.name}", None) for f in fields(cls)}
        return cls(**{k: int(v) for k, v in found.items() if v is not None})
