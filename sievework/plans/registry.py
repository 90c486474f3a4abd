"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import slices
from ..operators.gate import RELATIONS, Gate
from .fixtures import relation, with_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, build: Callable[..., DataFrame], *relations: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Register a query over relations (then plain tables); sql reads the same relations by name."""
    QUERIES[name] = lambda spark, d: build(*[relation(spark, d, r) for r in relations], *[table(spark, d, t) for t in tables])
    if sql:
        ORACLES[name] = (with_relations(*relations) + " " if relations else "") + sql


def add_sliced(name: str, build: Callable[..., DataFrame], *relations: str, sql: str, grows: int = 1) -> None:
    """Register a query over relations whose rows of a review need that review's rows alone: large relations go in slices.

    grows: rows that the query makes of a row on its way, for the size of slices.
    """
    add(name, build, *relations, sql=sql)

    def query(spark: SparkSession, d: str) -> DataFrame:
        r = {n: relation(spark, d, n) for n in relations}
        where = _slices(spark, d, relations, grows)
        return slices.in_slices(where, r, lambda own: nullcontext(build(*own.values())), name) if where else build(*r.values())

    QUERIES[name] = query


_gates: dict[tuple, Gate] = {}
_cuts: dict[tuple, list[Column]] = {}


def _stamps(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, *(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))


def _slices(spark: SparkSession, sf_dir: str, names: tuple[str, ...], grows: int = 1) -> list[Column]:
    """The slices of a folder's relations, measured once a session; none where they are small."""
    key = (names, grows, *_stamps(spark, sf_dir))
    if key not in _cuts:
        _cuts[key] = slices.slices([relation(spark, sf_dir, n) for n in names], slices.SLICE_ROWS // grows)
    return _cuts[key]


def shared_gate(spark: SparkSession, sf_dir: str) -> Gate:
    """The gate over a folder's tables: its facts are made once a session, until ``end_gates`` or a change of the tables."""
    key = _stamps(spark, sf_dir)
    if key not in _gates:
        _gates[key] = Gate(**{r: relation(spark, sf_dir, r) for r in RELATIONS})
    return _gates[key]


def end_gates() -> None:
    """Delete what the shared gates wrote: for when no result of theirs will be read again."""
    while _gates:
        _gates.popitem()[1].end()


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time of change and length of a table's file or folder."""
    context = spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    status = file.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(file)
    return status.getModificationTime(), status.getLen()


@contextmanager
def _part_of(part: Callable[[Gate], DataFrame], relations: dict[str, DataFrame]) -> Iterator[DataFrame]:
    with Gate(**relations) as gate:
        yield part(gate)


def add_gate(name: str, part: Callable[[Gate], DataFrame], sql: str, needs: tuple[str, ...] = RELATIONS) -> None:
    """Register a query over a part of the gate. Small tables share one; large ones go in slices, each with a gate of its own.

    needs: the relations that the part shuffles, for the size of slices; none if it shuffles nothing large.
    """

    def query(spark: SparkSession, d: str) -> DataFrame:
        where = _slices(spark, d, needs) if needs else []
        if not where:
            return part(shared_gate(spark, d))
        return slices.in_slices(where, {r: relation(spark, d, r) for r in RELATIONS}, lambda own: _part_of(part, own), name)

    QUERIES[name] = query
    ORACLES[name] = with_relations(*RELATIONS) + sql


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)
