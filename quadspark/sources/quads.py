"""A DataFrame of quads (s TERM, p string, o TERM, g string; g "" is the default graph) as a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.operators.relation import Rel, cname, join, table_bytes
from quadspark.plans.algebra import Pattern, TripleTerm, Var
from quadspark.terms import IRI, RDF, TERM, TRIPLE, Enc, Term

TYPE = RDF + "type"

QUADS = T.StructType([T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM), T.StructField("g", T.StringType())])


def matches(col: Column, t: Term) -> Column:
    """Whether a TERM is this one."""
    out = (col["k"] == t.k) & (col["v"] == t.v)
    if t.k == 2:
        out = out & (col["dt"] == t.dt) & (col["lang"] == t.lang if t.lang else col["lang"].isNull())
        if t.dir:
            out = out & (col["dir"] == t.dir)
    return out


def rows(spark: SparkSession, quads: list[tuple[Term, str, Term, str]]) -> DataFrame:
    """A small DataFrame of quads."""
    cell = lambda t: (t.k, t.v, t.dt, t.lang, t.dir)
    return spark.createDataFrame([(cell(s), p, cell(o), g) for s, p, o, g in quads], QUADS)


def write_by_predicate(quads: DataFrame, path: str) -> None:
    """A folder for each predicate, so that a pattern reads only its own; within it rows are
    sorted by subject, so that a constant subject skips most row groups. Quads of one predicate
    are dealt over several tasks: a common predicate is no hot one."""
    spread = quads.withColumn("_part", F.pmod(F.xxhash64("s"), F.lit(16))).repartition("p", "_part").drop("_part")
    spread.sortWithinPartitions("p", "s.v").write.partitionBy("p").parquet(path)


def read_by_predicate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s struct<k:int,v:string,dt:string,lang:string,dir:string>, o struct<k:int,v:string,dt:string,lang:string,dir:string>, g string, p string").parquet(path).select("s", "p", "o", "g")


class QuadSource:
    """union_default: the default graph is the union of all, each triple once."""

    def __init__(self, df: DataFrame, union_default: bool = False) -> None:
        self.df, self.union_default = df.select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g")), union_default
        self.bytes: float | None = None

    def star(self, s: object, pairs: list[tuple[object, object]], g: object) -> Rel:
        """Patterns with one subject. Joins on it are on one key, so one shuffle serves them all."""
        return reduce(join, (self.pattern(Pattern(s, p, o, g)) for p, o in pairs))

    def estimate(self, s: object, pairs: list[tuple[object, object]], g: object) -> tuple[float, dict[str, float]]:
        """Rows of a star, and different values of its variables, from the size of the data and rules of thumb."""
        if self.bytes is None:
            self.bytes = table_bytes(self.df)
        each = [self.bytes / 60 * (0.1 if isinstance(p, Term) else 1.0) * ((0.2 if isinstance(p, Term) and p.v == TYPE else 0.01) if isinstance(o, Term) else 1.0) for p, o in pairs]
        rows = max(1.0, min(each) * (0.001 if isinstance(s, Term) else 1.0))
        values = {s.name: rows} if isinstance(s, Var) else {}
        for _, o in pairs:
            if isinstance(o, Var):
                values.setdefault(o.name, max(1.0, rows / 3))
        return rows, values

    def graph(self, g: object) -> tuple[DataFrame, Column | None]:
        """The quads of graph g, and the column that binds it."""
        if isinstance(g, Var):
            return self.df.where("g <> ''"), F.col("g")
        if isinstance(g, frozenset):  # a default graph made of several graphs
            return self.df.where(F.col("g").isin(*sorted(g))).select("s", "p", "o").distinct(), None
        if isinstance(g, Term):
            return self.df.where(F.col("g") == g.v), None
        if self.union_default:
            return self.df.select("s", "p", "o").distinct(), None
        return self.df.where("g = ''"), None

    def pattern(self, t: Pattern) -> Rel:
        df, graph = self.graph(t.g)
        columns: dict[str, tuple[Column, Enc]] = {}
        cond: list[Column] = []

        def place(x: object, col: Column, enc: Enc) -> None:
            if isinstance(x, Var):
                if x.name not in columns:
                    columns[x.name] = (col, enc)
                else:  # the same variable again
                    other, kind = columns[x.name]
                    cond.append(other == col if kind == enc else _term(other, kind) == _term(col, enc))
            elif isinstance(x, TripleTerm):
                from quadspark.functions.calls import component
                from quadspark.functions.expr import Val

                cond.append(col["k"] == TRIPLE)
                for i, part in enumerate((x.s, x.p, x.o), 1):
                    piece = component(i)(None, Val(col, "term")).col
                    place(part, piece, Enc("term"))
            else:
                cond.append(matches(col, x) if enc.kind == "term" else col == (x.v if x.k == IRI else None))

        place(t.s, F.col("s"), Enc("term"))
        place(t.p, F.col("p"), Enc("iri", None))
        place(t.o, F.col("o"), Enc("term"))
        if graph is not None:
            place(t.g, graph, Enc("iri", None))
        for c in cond:
            df = df.where(c)
        return Rel(df.select(*[c.alias(cname(v)) for v, (c, _) in columns.items()]), {v: e for v, (_, e) in columns.items()})

    def nodes(self, g: object) -> DataFrame:
        """Distinct terms (n, and g if it is a variable) in subject or object position."""
        df, graph = self.graph(g)
        extra = [graph.alias("g")] if graph is not None else []
        return df.select(F.col("s").alias("n"), *extra).union(df.select(F.col("o").alias("n"), *extra)).distinct()


def _term(c: Column, e: Enc) -> Column:
    from quadspark.terms import box

    return box(c, e)
