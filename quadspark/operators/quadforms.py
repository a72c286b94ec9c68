"""Results that are quads: CONSTRUCT and DESCRIBE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions.calls import compile_expr
from quadspark.operators.relation import Rel, join
from quadspark.plans.algebra import Const, Pattern, TripleTerm, Var
from quadspark.terms import BNODE, IRI, TRIPLE, Term, box, term_col


def instantiate(r: Rel, template: tuple, context, distinct: bool = False) -> DataFrame:  # noqa: ANN001
    """Quads (s, p, o, g) of the template for each solution. Blank nodes are fresh for each one;
    a quad with an unbound or misplaced term is left out."""
    fresh = any(isinstance(x, Term) and x.k == BNODE for t in template for x in (t.s, t.o))
    df = r.df.withColumn("__row", F.monotonically_increasing_id()) if fresh else r.df

    def cell(x: object) -> Column:
        if isinstance(x, Term) and x.k == BNODE:
            return term_col(BNODE, F.concat(F.lit(f"c{x.v}x"), F.col("__row").cast("string")))
        if isinstance(x, (Var, TripleTerm)):
            return compile_expr(x, r.scope(), context).term()
        return compile_expr(Const(x), {}, context).term()

    quads = []
    for t in template:
        s, p, o = cell(t.s), cell(t.p), cell(t.o)
        g = cell(t.g) if t.g is not None else None
        ok = s["k"].isin(IRI, BNODE, TRIPLE) & (p["k"] == IRI) & o.isNotNull()
        if g is not None:
            ok = ok & (g["k"] == IRI)
        quads.append(F.when(ok, F.struct(s.alias("s"), p["v"].alias("p"), o.alias("o"), (g["v"] if g is not None else F.lit("")).alias("g"))))
    out = df.select(F.explode(F.array(*quads)).alias("q")).where("q IS NOT NULL").select("q.s", "q.p", "q.o", "q.g")
    return out.distinct() if distinct else out


def describe(lowering, r: Rel, targets: tuple) -> DataFrame:  # noqa: ANN001
    """All triples whose subject is one of the targets."""
    out = None
    for i, t in enumerate(targets):
        p, o = Var(f".dp{i}"), Var(f".do{i}")
        if isinstance(t, Var):
            subject = Var(t.name)
            if t.name not in r.vars:
                continue
            mine = r.only([t.name])
            mine = Rel(mine.df.distinct(), dict(mine.vars), set(mine.nullable))
            found = join(mine, lowering.about(Pattern(subject, p, o), mine.vars[t.name]))
            s = box(found.col(t.name), found.vars[t.name])
        else:
            found = lowering.pattern(Pattern(t, p, o))
            s = term_col(t.k, F.lit(t.v))
        pe = found.vars[p.name]
        pred = found.col(p.name)["v"] if pe.kind == "term" else found.col(p.name)
        df = found.df.select(s.alias("s"), pred.alias("p"), box(found.col(o.name), found.vars[o.name]).alias("o"), F.lit("").alias("g"))
        out = df if out is None else out.union(df)
    if out is None:
        none = lowering.pattern(Pattern(Var("s"), Var("p"), Var("o"))).boxed({"s", "o"})
        return none.df.where(F.lit(False)).select(none.col("s").alias("s"), none.col("p").alias("p"), none.col("o").alias("o"), F.lit("").alias("g"))
    return out.distinct()
