"""Property paths: negated sets and closures.

A closure is a semi-naive fixpoint: only the pairs found last are extended, those known already
are dropped, and each round is a table in the shared folder. What is known is made one table
again every few rounds. If both ends are free and the paths go on for long, rounds come to double
the length instead. From a constant end only what is reachable is visited. Closures are sets of
pairs, within each graph by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.operators.relation import Rel, cname, join, union
from quadspark.operators.scratch import written
from quadspark.plans.algebra import Alt, Closure, Inv, Link, Nps, PathPattern, Pattern, Seq, Var
from quadspark.terms import TERM_DDL, Enc, Term, box, iri, lit_col

MOST_ROUNDS = 10_000
#: Rounds after which what is known becomes one table, and after which lengths are doubled.
COMPACT, DOUBLE_AFTER = 8, 16


def pairs(path: object, g: object, pattern: Callable[[Pattern], Rel], nodes: Callable[[object], DataFrame]) -> Rel:
    """All (.from, .to) of a path, and the graph variable's binding."""
    a, b = Var(".from"), Var(".to")
    match path:
        case Link():
            return pattern(Pattern(a, iri(path.iri), b, g))
        case Inv():
            r = pairs(path.path, g, pattern, nodes)
            swap = {".from": ".to", ".to": ".from"}
            return Rel(r.df.select(*[r.col(v).alias(cname(swap.get(v, v))) for v in r.vars]), {swap.get(v, v): e for v, e in r.vars.items()})
        case Seq():
            out = pairs(path.parts[0], g, pattern, nodes)
            for p in path.parts[1:]:
                nxt = pairs(p, g, pattern, nodes)
                left = Rel(out.df.withColumnRenamed(cname(".to"), cname(".mid")), {(".mid" if v == ".to" else v): e for v, e in out.vars.items()})
                right = Rel(nxt.df.withColumnRenamed(cname(".from"), cname(".mid")), {(".mid" if v == ".from" else v): e for v, e in nxt.vars.items()})
                both = join(left, right)
                out = both.only([v for v in both.vars if v != ".mid"])
            return out
        case Alt():
            return union([pairs(p, g, pattern, nodes) for p in path.parts])
        case Nps():
            parts = []
            if path.forward or not path.inverse:
                parts.append(_but(pattern(Pattern(a, Var(".p"), b, g)), path.forward))
            if path.inverse:
                parts.append(_but(pattern(Pattern(b, Var(".p"), a, g)), path.inverse))
            return union(parts)
        case Closure():
            return closure(path, None, None, g, pattern, nodes)
    raise TypeError(f"no path: {path!r}")


def _but(r: Rel, excluded: tuple[str, ...]) -> Rel:
    p = r.vars[".p"]
    text = r.col(".p")["v"] if p.kind == "term" else r.col(".p")
    df = r.df.where(~text.isin(*excluded)) if excluded else r.df
    return Rel(df, dict(r.vars)).only([v for v in r.vars if v != ".p"])


def closure(path: Closure, start: Term | None, end: Term | None, g: object, pattern: Callable, nodes: Callable) -> Rel:
    """(.from, .to) of ?, + or * of a path, each pair once."""
    steps = pairs(path.path, g, pattern, nodes)
    graph = [g.name] if isinstance(g, Var) else []
    kinds = {steps.vars[".from"], steps.vars[".to"]}
    if len(kinds) > 1 or path.kind != "+" or start or end or graph:
        steps = steps.boxed({".from", ".to", *graph})
    enc = steps.vars[".from"]
    names = [".from", ".to", *graph]
    steps = steps.only(names)
    df = steps.df
    if end is not None and start is None:  # from the known end backwards
        back = closure(Closure(Inv(path.path), path.kind), end, None, g, pattern, nodes)
        return Rel(back.df.select(back.col(".to").alias(cname(".from")), back.col(".from").alias(cname(".to")), *[back.col(x) for x in graph]), {v: back.vars[v] for v in names})
    f, t, gs = F.col(f"`{cname('.from')}`"), F.col(f"`{cname('.to')}`"), [F.col(f"`{cname(x)}`") for x in graph]
    spark: SparkSession = df.sparkSession
    identity = None
    if path.kind in "?*":
        if start is not None:
            if graph:
                identity = nodes(g).select(F.col("g")).distinct().select(lit_col(start).alias("n"), _graph_term(F.col("g")))
            else:
                identity = spark.range(1).select(lit_col(start).alias("n"))
        else:
            every = nodes(g)
            identity = every.select("n", *([_graph_term(F.col("g"))] if graph else []))
        identity = identity.select(F.col("n").alias(cname(".from")), F.col("n").alias(cname(".to")), *([F.col("g").alias(cname(graph[0]))] if graph else []))
    first = df.where(box(f, enc) == lit_col(start)) if start is not None else df
    out = {v: steps.vars[v] for v in names}
    if path.kind == "?":
        return Rel(first.select(f, t, *gs).union(identity).distinct(), out)
    edges = written(df.distinct())
    known = written(first.select(f, t, *gs).distinct())
    if identity is not None:
        known = written(known.union(identity).distinct())
    delta, keys = known, [cname(v) for v in names]

    def after(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of a step of left and one of right."""
        hop = right.select(f.alias("x_from"), t.alias("x_to"), *[c.alias("x_g") for c in gs])
        on = left[cname(".to")] == hop["x_from"]
        if graph:
            on = on & (left[cname(graph[0])] == hop["x_g"])
        return left.join(hop, on).select(left[cname(".from")].alias(cname(".from")), hop["x_to"].alias(cname(".to")), *([left[cname(graph[0])].alias(cname(graph[0]))] if graph else [])).distinct()

    for n in range(1, MOST_ROUNDS):
        delta = written(after(delta, edges).join(known, keys, "left_anti").select(*[F.col(f"`{k}`") for k in keys]))
        if delta.isEmpty():
            return Rel(known, out)
        known = known.union(delta)
        if n % COMPACT == 0:
            known = written(known)  # one table again: a plan of a few scans, whatever the round
        if n == DOUBLE_AFTER and start is None:
            return Rel(_doubled(known, edges, keys, after, n + 1), out)
    raise RuntimeError("a path closure didn't end")


def _doubled(known: DataFrame, edges: DataFrame, keys: list[str], after: Callable, length: int) -> DataFrame:
    """A closure with both ends free that goes on for long: known holds all walks of up to `length`
    steps. Walks of exactly `length` steps lead on from them, so each round doubles what is covered."""
    exact, todo = None, length
    power = edges
    while todo:  # walks of exactly length steps, by squaring
        if todo & 1:
            exact = power if exact is None else written(after(exact, power))
        todo >>= 1
        if todo:
            power = written(after(power, power))
    for _ in range(MOST_ROUNDS):
        found = written(after(known, exact).join(known, keys, "left_anti").select(*[F.col(f"`{k}`") for k in keys]))
        if found.isEmpty():
            return known
        known = written(known.union(found))
        exact = written(after(exact, exact))
    raise RuntimeError("a path closure didn't end")


def _graph_term(g):  # noqa: ANN001, ANN202
    return box(g, Enc("iri", None)).cast(TERM_DDL).alias("g")


def lower_path(p: PathPattern, pattern: Callable, nodes: Callable) -> Rel:
    """A path pattern with its ends' variables, or constants, in place."""
    start, end = (x if isinstance(x, Term) else None for x in (p.s, p.o))
    if isinstance(p.path, Closure):
        r = closure(p.path, start, end, p.g, pattern, nodes)
    else:
        r = pairs(p.path, p.g, pattern, nodes)
    df = r.df
    for x, v in ((start, ".from"), (end, ".to")):
        if x is not None:
            df = df.where(box(r.col(v), r.vars[v]) == lit_col(x))
    r = Rel(df, dict(r.vars))
    if isinstance(p.s, Var) and isinstance(p.o, Var) and p.s.name == p.o.name:
        same = r.df.where(box(r.col(".from"), r.vars[".from"]) == box(r.col(".to"), r.vars[".to"]))
        r = Rel(same, dict(r.vars)).only([v for v in r.vars if v != ".to"])
    names = {".from": p.s, ".to": p.o}
    keep = [v for v in r.vars if v not in names or isinstance(names[v], Var)]
    to = {v: names[v].name if v in names else v for v in keep}
    return Rel(r.df.select(*[r.col(v).alias(cname(to[v])) for v in keep]), {to[v]: r.vars[v] for v in keep})
