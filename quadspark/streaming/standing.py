"""Standing queries: the monotone part of the algebra over a stream.

A table may be read as a stream; patterns, filters, bindings, projections, unions, joins with
static tables, and grouping then run incrementally as structured streaming. What would have to
take results back (OPTIONAL, MINUS, NOT EXISTS, ORDER BY, LIMIT) is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadspark.engine import Engine
from quadspark.plans.algebra import Bgp, Call, Closure, Exists, Extend, Filter, Group, Join, LeftJoin, Minus, OrderBy, PathPattern, Project, Query, Reduced, Slice, Union, Values
from quadspark.sources.virtual import TableSource
from quadspark.terms import value


def check(p: object) -> None:
    match p:
        case Bgp() | Values():
            return
        case PathPattern():
            if isinstance(p.path, Closure):
                raise ValueError("a closure isn't incremental")
        case Join():
            check(p.left), check(p.right)
        case Union():
            for x in p.parts:
                check(x)
        case Filter():
            if _has_exists(p.expr):
                raise ValueError("EXISTS isn't incremental")
            check(p.input)
        case Extend() | Project() | Reduced() | Group():
            check(p.input)
        case LeftJoin() | Minus() | OrderBy() | Slice():
            raise ValueError(f"{type(p).__name__} isn't incremental")
        case _:
            raise ValueError(f"{type(p).__name__} isn't incremental")


def _has_exists(e: object) -> bool:
    return isinstance(e, Exists) or isinstance(e, Call) and any(map(_has_exists, e.args))


def stream_query(spark: SparkSession, text: str, load: Callable[[str], DataFrame], **options) -> DataFrame:  # noqa: ANN003
    """A streaming DataFrame. load gives each table, some of them as streams (readStream)."""
    source = TableSource(load)
    e = Engine(spark, source, **options)
    q: Query = e.parse(text)
    check(q.plan)
    r = e.relation(q)
    return r.df.select(*[value(r.col(v), r.vars[v]).alias(v) for v in q.vars])


def start(df: DataFrame, name: str, checkpoint: str | None = None, complete: bool = False) -> StreamingQuery:
    """Runs what there is into a table in memory named name. Grouped results are complete at each step."""
    w = df.writeStream.format("memory").queryName(name).outputMode("complete" if complete else "append").trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
