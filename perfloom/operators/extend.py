"""Points at which a user's own parts come in: columns, resolvers, containment, sinks, samplers, tracing, pickers; and the graph built whole."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import joins
from .graph import flipped, settle
from .reaching import Reached
from .review import redirect_constructors
from .symbols import in_scope


def adapted(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of any graph under the names that operators use: {name here: expression there}."""
    return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def build(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, classes: DataFrame | None = None, resolver: Callable[..., DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """A call graph of references (ref, src, name, file, lang, line) and symbols: edges (src, dst), each once; and calls out of the project (src, name, line), each once.

    resolver(refs, symbols) gives edges (ref, src, dst) in place of imports and names; classes (id, constructor) take calls of a class to its constructor.
    """
    if resolver is not None:
        found = resolver(refs, symbols)
    elif imports is not None:
        found = joins.resolve(refs, imports, symbols)
    else:
        found = joins.resolve_names(refs, symbols)
    edges = found.select("src", "dst").distinct()
    if classes is not None:
        edges = redirect_constructors(edges, classes)
    outside = refs.join(found.select("ref").distinct(), "ref", "left_anti").groupBy("src", "name", "line").agg(F.count(F.lit(1)).alias("n"))
    return edges.filter("src <> dst"), outside


def affected_by_files(changed: DataFrame, symbols: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (path, root) that reach a symbol of a changed file; and changed paths with symbols that no root reaches."""
    own = in_scope(symbols, changed).select(F.col("file").alias("root"), "id")
    hit = settle(Reached(own, flipped(edges)).at(roots).select(F.col("root").alias("path"), F.col("id").alias("root")))
    return hit, own.select(F.col("root").alias("path")).distinct().join(hit.select("path").distinct(), "path", "left_anti")


def contained(ranges: DataFrame, extractor: Callable[[DataFrame], DataFrame] = joins.containment) -> DataFrame:
    """Parents of ranges by an extractor; the lexical one if none is given."""
    return extractor(ranges)


def picked(roots: DataFrame, picker: Callable[[list], int | None], most: int = 200) -> str | None:
    """The id of the root that a picker chooses from a bounded list; none if it declines."""
    shown = roots.limit(most).collect()
    at = picker(shown)
    return None if at is None else shown[at].id


def wrapped(sink: Callable[[DataFrame, int], None], *layers: Callable[[Callable[[DataFrame, int], None]], Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A sink with layers around it, the last one outermost."""
    return functools.reduce(lambda inner, layer: layer(inner), layers, sink)


def traced(emit: Callable[[dict], None]):
    """A decorator that emits a function_call event for each call, with its status; what the function raises is raised on."""

    def around(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began, status = time.time_ns(), "ok"
            try:
                return f(*args, **kwargs)
            except BaseException:
                status = "error"
                raise
            finally:
                end = time.time_ns()
                emit({"type": "function_call", "time": str(end), "qualname": f.__qualname__, "file": f.__code__.co_filename, "line": f.__code__.co_firstlineno, "duration_ns": max(end - began, 1), "status": status})

        return run

    return around


def backoff(errors: int, base: float = 1.0, factor: float = 1.5, most: float = 60.0, rng: random.Random | None = None) -> float:
    """Seconds to wait after so many errors in a row: growing by a factor up to `most`, with full jitter of half of it."""
    wait = min(most, base * factor ** max(errors - 1, 0))
    return wait / 2 + (rng or random).random() * wait / 2


class SamplerSource(DataSource):
    """A table of what a sampler gives: an object with `profile(window) -> rows of (stack, n)`, one partition a window."""

    sampler: Callable[[int], Iterable[tuple[str, int]]] = staticmethod(lambda window: ())

    @classmethod
    def name(cls) -> str:
        return "sampler"

    def schema(self) -> str:
        return "window int, stack string, n long"

    def reader(self, schema) -> DataSourceReader:
        return SamplerReader(int(self.options.get("windows", "1")), type(self).sampler)


class SamplerReader(DataSourceReader):
    def __init__(self, windows: int, sampler):
        self.windows, self.sampler = windows, sampler

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(i) for i in range(self.windows)]

    def read(self, partition) -> Iterator[tuple]:
        for stack, n in self.sampler(partition.value):
            yield partition.value, stack, n
