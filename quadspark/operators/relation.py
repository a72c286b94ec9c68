"""Relations of solutions: a DataFrame with a column for each variable, how each is encoded,
and which may be unbound. Joins on compatible solutions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.terms import Enc, box


def cname(var: str) -> str:
    return "v_" + var.replace(".", "~")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Enc]
    nullable: set[str] = field(default_factory=set)
    unit: bool = False  # one solution without variables

    def col(self, var: str) -> Column:
        return quoted(cname(var))

    def scope(self) -> dict[str, tuple[Column, Enc]]:
        return {v: (self.col(v), e) for v, e in self.vars.items()}

    def boxed(self, names: set[str]) -> Rel:
        """With these variables as TERMs."""
        change = {v for v in names if v in self.vars and self.vars[v].kind != "term"}
        if not change:
            return self
        df = self.df.select(*[(box(self.col(v), e) if v in change else self.col(v)).alias(cname(v)) for v, e in self.vars.items()])
        return Rel(df, {v: Enc("term") if v in change else e for v, e in self.vars.items()}, set(self.nullable))

    def only(self, names: list[str]) -> Rel:
        return Rel(self.df.select(*[self.col(v) for v in names]), {v: self.vars[v] for v in names}, self.nullable & set(names))

    def filled(self, names: list[str]) -> Rel:
        """With exactly these variables; those it doesn't have are unbound."""
        none = F.lit(None).cast("struct<k:int,v:string,dt:string,lang:string,dir:string>")
        df = self.df.select(*[(self.col(v) if v in self.vars else none).alias(cname(v)) for v in names])
        return Rel(df, {v: self.vars.get(v, Enc("term")) for v in names}, {v for v in names if v not in self.vars} | (self.nullable & set(names)))


def table_bytes(df: DataFrame) -> float:
    """Spark's estimate of a plan's size, which takes no job; of an unknown size, or a stream, 1 TB."""
    if df.isStreaming:
        return 1e12
    return min(1e12, float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def same(a: Enc, b: Enc) -> bool:
    """Whether the columns of both can be compared as they are."""
    return a == b


def unify(rels: list[Rel], names: set[str]) -> list[Rel]:
    """Relations whose common variables are encoded alike: as TERMs where they differ."""
    for v in names:
        kinds = {r.vars[v] for r in rels if v in r.vars}
        if len(kinds) > 1:
            whole = {Enc("iri", None)} if all(k.kind == "iri" for k in kinds) else None
            rels = [_full_iri(r, v) for r in rels] if whole else [r.boxed({v}) for r in rels]
    return rels


def _full_iri(r: Rel, v: str) -> Rel:
    if v not in r.vars or r.vars[v].template is None:
        return r
    e = r.vars[v]
    df = r.df.select(*[(F.concat(F.lit(e.template), r.col(x).cast("string")) if x == v else r.col(x)).alias(cname(x)) for x in r.vars])
    return Rel(df, r.vars | {v: Enc("iri", None)}, set(r.nullable))


def join(left: Rel, right: Rel, how: str = "inner", condition=None) -> Rel:  # noqa: ANN001
    """Solutions of both that are compatible. how: inner, left, left_semi, left_anti, or
    left_anti_minus, for which a shared variable must be bound on both sides. condition: a function
    of the merged scope.

    Spark gets an equality for every join that can have one: where all shared variables may be
    unbound, the sides are split by whether the first of them is bound, until a key remains."""
    if how == "inner" and condition is None:
        if left.unit:
            return right
        if right.unit:
            return left
    shared = [v for v in left.vars if v in right.vars]
    left, right = unify([left, right], set(shared))
    loose = [v for v in shared if v in left.nullable or v in right.nullable]
    if how == "left_anti_minus":
        return _minus(left, right, shared, loose)
    if loose and len(loose) == len(shared):
        return _split(left, right, loose[0], how, condition)
    return _on(left, right, shared, loose, how, condition)


def _on(left: Rel, right: Rel, shared: list[str], loose: list[str], how: str, condition=None) -> Rel:  # noqa: ANN001
    """One Spark join: the shared variables that are always bound are its keys."""
    other = right.df.select(*[right.col(v).alias(f"r_{cname(v)}") for v in right.vars])
    theirs = lambda v: quoted(f"r_{cname(v)}")
    on: Column | None = None
    for v in shared:
        eq = left.col(v) == theirs(v)
        if v in loose:
            eq = left.col(v).isNull() | theirs(v).isNull() | eq
        on = eq if on is None else on & eq
    merged = {v: (left.col(v), e) for v, e in left.vars.items()} | {v: (F.coalesce(left.col(v), theirs(v)), left.vars[v]) for v in loose} | {v: (theirs(v), e) for v, e in right.vars.items() if v not in shared}
    if condition is not None:
        c = condition(merged)
        on = c if on is None else on & c
    if on is None:
        if how in ("left_semi", "left_anti"):
            other = other.limit(1)
        df = left.df.crossJoin(other) if how == "inner" else left.df.join(other, F.lit(True), how)
    else:
        df = left.df.join(other, on, how)
    if how in ("left_semi", "left_anti"):
        return Rel(df, dict(left.vars), set(left.nullable))
    df = df.select(*[c.alias(cname(v)) for v, (c, _) in merged.items()])
    if how == "left":
        nullable = left.nullable | {v for v in right.vars if v not in shared}
    else:
        nullable = {v for v in left.nullable | right.nullable if not (v in shared and not (v in left.nullable and v in right.nullable))}
    return Rel(df, {v: e for v, (_, e) in merged.items()}, nullable)


def _bound(r: Rel, v: str) -> Rel:
    return Rel(r.df.where(r.col(v).isNotNull()), dict(r.vars), r.nullable - {v})


def _unbound(r: Rel, v: str) -> Rel:
    """The rows without a value of v, without that variable."""
    return Rel(r.df.where(r.col(v).isNull()), dict(r.vars), set(r.nullable)).only([x for x in r.vars if x != v])


def _split(left: Rel, right: Rel, v: str, how: str, condition) -> Rel:  # noqa: ANN001
    """A join of which v, like each shared variable, may be unbound."""
    if how == "left":  # what matches, and what nothing matches
        names = [*left.vars, *(x for x in right.vars if x not in left.vars)]
        return union([join(left, right, "inner", condition), join(left, right, "left_anti", condition)], names)
    mine = [_bound(left, v)] if v in left.nullable else [left]
    their = [_bound(right, v), _unbound(right, v)] if v in right.nullable else [right]
    if how == "inner":
        parts = [join(mine[0], t, "inner", condition) for t in their]
        if v in left.nullable:
            parts.append(join(_unbound(left, v), right, "inner", condition))
        return union(parts, [*left.vars, *(x for x in right.vars if x not in left.vars)])
    out = []
    rest = mine[0]
    for t in their:
        if how == "left_semi":
            out.append(join(rest, t, "left_semi", condition))
        rest = join(rest, t, "left_anti", condition)
    out = out if how == "left_semi" else [rest]
    if v in left.nullable:
        open_ = Rel(left.df.where(left.col(v).isNull()), dict(left.vars), set(left.nullable))
        out.append(_hidden(open_, v, right, how, condition))
    return union(out, list(left.vars))


def _hidden(left: Rel, v: str, right: Rel, how: str, condition) -> Rel:  # noqa: ANN001
    """A semi or anti join of rows whose v is unbound: v is the right side's, for the condition only."""
    names = [x for x in left.vars if x != v]
    found = join(left.only(names), right, how, condition)
    none = F.lit(None).cast(left.df.schema[cname(v)].dataType)
    return Rel(found.df.select(*[(none if x == v else found.col(x)).alias(cname(x)) for x in left.vars]), dict(left.vars), set(left.nullable))


def _minus(left: Rel, right: Rel, shared: list[str], loose: list[str]) -> Rel:
    """MINUS: without the solutions that are compatible with one of the right side and share a
    bound variable with it."""
    if not shared:
        return left
    if len(loose) < len(shared):
        return _on(left, right, shared, loose, "left_anti")
    v, rest = shared[0], shared[1:]
    both = _on(left, _bound(right, v) if v in right.nullable else right, shared, rest, "left_anti")  # a null key equals nothing
    if not rest:
        return both
    parts = []
    for here, there in ((_bound(both, v) if v in left.nullable else both, _unbound(right, v) if v in right.nullable else None), (Rel(both.df.where(both.col(v).isNull()), dict(both.vars), set(both.nullable)) if v in left.nullable else None, right)):
        if here is None:
            continue
        if there is None:
            parts.append(here)
            continue
        other = there.only([x for x in there.vars if x != v])
        parts.append(_minus(here, other, rest, [x for x in rest if x in here.nullable or x in other.nullable]))
    return union(parts, list(left.vars))


def union(parts: list[Rel], names: list[str] | None = None) -> Rel:
    names = names or list(dict.fromkeys(v for p in parts for v in p.vars))
    parts = unify(parts, set(names))
    enc = {v: next(p.vars[v] for p in parts if v in p.vars) if any(v in p.vars for p in parts) else Enc("term") for v in names}
    out, nullable = None, set()
    for p in parts:
        full = []
        for v in names:
            if v in p.vars:
                full.append(p.col(v).alias(cname(v)))
            else:
                model = next((q for q in parts if v in q.vars), None)
                kind = model.df.schema[cname(v)].dataType if model is not None else "struct<k:int,v:string,dt:string,lang:string,dir:string>"
                full.append(F.lit(None).cast(kind).alias(cname(v)))
                nullable.add(v)
        nullable |= p.nullable
        df = p.df.select(*full) if full else p.df.select()
        out = df if out is None else out.union(df)
    return Rel(out, enc, nullable & set(names))

