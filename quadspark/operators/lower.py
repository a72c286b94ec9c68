"""Plans to relations: every operator of the algebra as DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import expr as X
from quadspark.functions.calls import compile_expr
from quadspark.functions.expr import Context, Val
from quadspark.operators.paths import lower_path
from quadspark.operators.relation import Rel, cname, join, quoted, union
from quadspark.operators.scratch import written
from quadspark.plans.algebra import (
    Aggregate, Bgp, Call, Const, Distinct, Exists, Extend, Filter, Group, Join, LeftJoin, Minus, OrderBy, PathPattern, Pattern, Project, Reduced, Service, Slice, Union, Values, Var,
    certain, correlated, expr_vars, mentioned, node_vars,
)
from quadspark.sources.virtual import TableSource
from quadspark.terms import DECIMAL, INTEGER, LITERAL, STRING, TERM_DDL, Enc, Term, lexical, term_col


#: Rows that a pattern of unknown size counts as.
UNKNOWN_ROWS = 1e6


@dataclass
class Entry:
    """A part of a join: estimates of its rows and of each variable's different values."""

    names: set[str]
    rows: float
    values: dict[str, float] = field(default_factory=dict)
    make: Callable[[], Rel] | None = None
    bound: Callable[[Rel], Rel | None] | None = None  # makes it for the solutions found so far

    def with_(self, other: Entry) -> Entry:
        """An estimate of the join."""
        rows = self.rows * other.rows
        for v in self.names & other.names:
            rows /= max(self.values.get(v, self.rows), other.values.get(v, other.rows), 1.0)
        values = {v: min(rows, *(e.values.get(v, e.rows) for e in (self, other) if v in e.names)) for v in self.names | other.names}
        return Entry(self.names | other.names, max(rows, 1.0), values)


def join_order(entries: list[Entry]) -> list[int]:
    """From each part on, the one that keeps the join smallest comes next, and parts that share a
    variable come before others. Of these orders the one whose largest join is smallest; of
    equal ones that which begins with the largest part, so that the others are looked up by key."""
    best: tuple | None = None
    for first in range(len(entries)):
        at, order, left, most, total = entries[first], [first], [i for i in range(len(entries)) if i != first], 0.0, 0.0
        while left:
            i = min(left, key=lambda i: (not at.names & entries[i].names, at.with_(entries[i]).rows, -len(at.names & entries[i].names), i))
            at = at.with_(entries[i])
            order.append(i), left.remove(i)
            most, total = max(most, at.rows), total + at.rows
        rank = (round(math.log2(most + 1)), -entries[first].rows, total, first)
        if best is None or rank < best[0]:
            best = rank, order
    return best[1] if best else []


def joined(entries: list[Entry]) -> Rel | None:
    out = None
    for i in join_order(entries):
        r = entries[i].bound(out) if out is not None and entries[i].bound is not None else None
        r = entries[i].make() if r is None else r
        out = r if out is None else join(out, r)
    return out


def flat(p: object) -> list:
    return [*flat(p.left), *flat(p.right)] if isinstance(p, Join) else [p]


def visible(r: Rel) -> set[str]:
    """Its variables, without flags and row numbers."""
    return {v for v in r.vars if not v.startswith("!")}


class Lowering:
    def __init__(self, spark: SparkSession, sources: list, context: Context, services: dict[str, list] | None = None, default: tuple = (), named: tuple = (), opt_plus: bool = False, at: Callable[[str], object] | None = None) -> None:
        self.at = at  # finds a source by its address
        self.opt_plus = opt_plus
        self.spark, self.sources, self.c, self.services = spark, sources, context, services or {}
        self.default, self.named = default, named

    # patterns

    def graph(self, g: object) -> object:
        """The graph a pattern is matched in, given the query's FROM clauses."""
        if g is None and self.default:
            return frozenset(self.default)
        if g is None and self.named:
            return frozenset()
        return g

    def allowed(self, r: Rel, g: object) -> Rel:
        """A graph variable ranges over the named graphs of the dataset."""
        if isinstance(g, Var) and (self.named or self.default) and g.name in r.vars:
            e = r.vars[g.name]
            text = r.col(g.name)["v"] if e.kind == "term" else r.col(g.name)
            return Rel(r.df.where(text.isin(*self.named) if self.named else F.lit(False)), dict(r.vars), set(r.nullable))
        return r

    def closed(self, g: object) -> bool:
        return isinstance(g, Term) and bool(self.named or self.default) and g.v not in self.named

    def star(self, s: object, found: list[tuple[object, object]], g: object) -> Rel:
        if self.closed(g):
            g = frozenset()
        if len(self.sources) == 1:
            return self.allowed(self.sources[0].star(s, found, self.graph(g)), g)
        out = None  # each pattern may have its matches anywhere
        for p, o in found:
            r = union([x.star(s, [(p, o)], self.graph(g)) for x in self.sources])
            out = r if out is None else join(out, r)
        return self.allowed(out, g)

    def pattern(self, t: Pattern) -> Rel:
        return self.star(t.s, [(t.p, t.o)], t.g)

    def about(self, t: Pattern, subject: Enc) -> Rel:
        """A pattern whose subject will be joined to values of an encoding."""
        tables = lambda x: {"subject": subject} if isinstance(x, TableSource) else {}
        parts = [x.star(t.s, [(t.p, t.o)], self.graph(t.g), **tables(x)) for x in self.sources]
        return parts[0] if len(parts) == 1 else union(parts)

    def nodes(self, g: object) -> DataFrame:
        parts = [x.nodes(self.graph(g)) for x in self.sources]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct() if len(parts) > 1 else out

    def bgp(self, b: Bgp) -> Rel:
        """Patterns are grouped into stars by subject, which are joined in an order by estimates."""
        return joined(self.stars(b)) or self.unit()

    def stars(self, b: Bgp) -> list[Entry]:
        groups: dict[tuple, list] = {}
        for t in b.patterns:
            groups.setdefault((t.s, t.g), []).append((t.p, t.o))
        out = []
        for (s, g), found in groups.items():
            names = node_vars(s) | node_vars(g) | set().union(*(node_vars(p) | node_vars(o) for p, o in found))
            known = [x.estimate(s, found, g) for x in self.sources]
            rows = max(1.0, sum(n for n, _ in known))
            values = {v: min(rows, sum(d.get(v, n) for n, d in known)) for v in names}
            bound = None
            if len(self.sources) == 1 and hasattr(self.sources[0], "bound_star") and not self.closed(g):
                bound = lambda left, s=s, found=found, g=g: self.sources[0].bound_star(left, s, found, self.graph(g))
            out.append(Entry(names, rows, values, lambda s=s, found=found, g=g: self.star(s, found, g), bound))
        return out

    def inner_join(self, p: Join) -> Rel:
        """Nested joins are one join of many: patterns come together, and the order is by estimates."""
        parts = flat(p)
        entries = self.stars(Bgp(tuple(t for x in parts if isinstance(x, Bgp) for t in x.patterns)))
        for x in parts:
            if isinstance(x, Bgp):
                continue
            r = self.lower(x)
            if r.unit:
                continue
            rows = float(max(1, len(x.rows)) if isinstance(x, Values) else UNKNOWN_ROWS)
            entries.append(Entry(set(r.vars), rows, {}, lambda r=r: r))
        return joined(entries) or self.unit()

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(), {}, set(), True)

    # operators

    def lower(self, p: object) -> Rel:
        match p:
            case Bgp():
                return self.bgp(p)
            case PathPattern():
                return self.allowed(lower_path(p, self.pattern, self.nodes), p.g)
            case Join():
                return self.inner_join(p)
            case LeftJoin():
                return self.left_join(p)
            case Union():
                return union([self.lower(x) for x in p.parts])
            case Minus():
                return join(self.lower(p.left), self.lower(p.right), "left_anti_minus")
            case Filter():
                return self.filter(p)
            case Extend():
                return self.extend(self.lower(p.input), p.var, p.expr)
            case Values():
                return self.values(p)
            case Group():
                return self.group(p)
            case Project():
                return self.lower(p.input).filled(list(p.vars))
            case Distinct():
                r = self.lower(p.input)
                return Rel(r.df.dropDuplicates() if r.vars else r.df.limit(1), dict(r.vars), set(r.nullable))
            case Reduced():
                return self.lower(p.input)
            case OrderBy():
                return self.order(p)
            case Slice():
                r = self.lower(p.input)
                df = r.df.offset(p.offset) if p.offset else r.df
                return Rel(df.limit(p.limit) if p.limit is not None else df, dict(r.vars), set(r.nullable))
            case Service():
                return self.service(p)
        raise TypeError(f"no operator: {p!r}")

    def values(self, p: Values) -> Rel:
        columns: dict[str, Enc] = {}
        native = {}
        for i, v in enumerate(p.vars):
            vals = [X.constant(row[i]) if row[i] is not None else None for row in p.rows]
            kinds = {x.t for x in vals if x is not None}
            native[v] = len(kinds) == 1 and kinds <= {"integer", "string", "iri", "boolean"} and all(x is None or x.t == "iri" or str(x.const.v) == _canonical(x.const) for x in vals)
            columns[v] = (Enc("iri", None) if kinds == {"iri"} else Enc("lit", None, X.DT_OF[next(iter(kinds))])) if native[v] else Enc("term")
        if not p.rows or not p.vars:
            n = len(p.rows)
            df = self.spark.range(n).select(*[F.lit(None).cast(TERM_DDL).alias(cname(v)) for v in p.vars])
            return Rel(df, {v: Enc("term") for v in p.vars}, set(p.vars))
        kind = {"integer": "bigint", "string": "string", "boolean": "boolean"}
        types, cells = [], []
        for v in p.vars:
            e = columns[v]
            types.append(f"`{cname(v)}` " + (TERM_DDL if e.kind == "term" else "string" if e.kind == "iri" else kind[X.TYPE_OF[e.dt]]))
        for row in p.rows:
            cell = []
            for v, t in zip(p.vars, row, strict=True):
                e = columns[v]
                cell.append(None if t is None else (t.k, t.v, t.dt, t.lang, t.dir) if e.kind == "term" else t.v if e.kind == "iri" or e.dt == STRING else int(t.v) if e.dt == INTEGER else t.v in ("true", "1"))
            cells.append(tuple(cell))
        undefined = {v for i, v in enumerate(p.vars) if any(r[i] is None for r in p.rows)}
        return Rel(self.spark.createDataFrame(cells, ", ".join(types)), columns, undefined)

    def extend(self, r: Rel, var: str, e: object) -> Rel:
        if var in r.vars:
            raise ValueError(f"?{var} is bound already")
        r = self.with_exists(r, e)
        x = compile_expr(e, r.scope(), self.c)
        names = [v for v in r.vars if not v.startswith("!")]
        df = r.df.select(*[r.col(v) for v in names], computed(x, e).alias(cname(var)))
        return Rel(df, {v: r.vars[v] for v in names} | {var: x.enc}, (r.nullable & set(names)) | ({var} if x.const is None else set()))

    def filter(self, p: Filter) -> Rel:
        r = self.lower(p.input)
        for part in conjuncts(p.expr):
            negated = False
            e = part
            while isinstance(e, Call) and e.name == "!" and len(e.args) == 1:
                e, negated = e.args[0], not negated
            if isinstance(e, Exists):
                r = self.semi(r, e.plan, negated != e.negated)
                continue
            named = list(r.vars)
            x = self.with_exists(r, part)
            kept = x.df.where(X.ebv(compile_expr(part, x.scope(), self.c)))
            r = Rel(kept, dict(x.vars), set(x.nullable)).only(named) if x is not r else Rel(kept, dict(r.vars), set(r.nullable))
        return r

    def semi(self, r: Rel, plan: object, negated: bool) -> Rel:
        """EXISTS as a semi or anti join. Filters at the pattern's top that speak of outer variables
        are its condition; a pattern that needs them anywhere deeper is evaluated from seeds."""
        outer, late, inner = visible(r), [], plan
        while isinstance(inner, Filter) and not correlated(inner.input, outer):
            parts = conjuncts(inner.expr)
            free = [e for e in parts if (mentioned(e) - certain(inner.input)) & outer]
            if any(exists_in(e) for e in free):
                break
            late += free
            own = [e for e in parts if e not in free]
            if own:
                inner = Filter(inner.input, reduce(lambda a, b: Call("&&", (a, b)), own))
                break
            inner = inner.input
        if correlated(inner, outer):
            marked, there = self.flagged(r, plan)
            return Rel(marked.df.where(~there if negated else there), dict(marked.vars), set(marked.nullable)).only(list(r.vars))
        right = self.lower(inner)

        def condition(scope: dict) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(X.ebv(compile_expr(e, scope, self.c)), F.lit(False)) for e in late])

        if right.unit and not late:
            return Rel(r.df.where(F.lit(not negated)), dict(r.vars), set(r.nullable))
        return join(r, right, "left_anti" if negated else "left_semi", condition if late else None)

    def with_exists(self, r: Rel, e: object) -> Rel:
        """Adds a flag for each EXISTS inside an expression; the number of rows stays."""
        for x in exists_in(e):
            r, there = self.flagged(r, x.plan)
            self.c.exists[id(x)] = ~there if x.negated else there
        return r

    def flagged(self, r: Rel, plan: object) -> tuple[Rel, Column]:
        """r with a flag, and the flag as a condition: whether the pattern has a solution in which
        the row's variables stand for their values."""
        outer, flag = visible(r), f"!{len(r.vars)}"
        there = F.coalesce(quoted(cname(flag)), F.lit(False))
        mark = {flag: Enc("lit", None, X.BOOLEAN)}
        if not correlated(plan, outer):
            right = self.lower(plan)
            shared = [v for v in right.vars if v in outer]
            if not shared:
                one = right.df.limit(1).select(F.lit(True).alias(cname(flag)))
                return join(r, Rel(one, mark), "left"), there
            if not any(v in r.nullable or v in right.nullable for v in shared):
                keys = right.only(shared)
                return join(r, Rel(keys.df.distinct().withColumn(cname(flag), F.lit(True)), keys.vars | mark), "left"), there
        used = [v for v in r.vars if v in mentioned(plan) & outer]
        row = f"!row{len(r.vars)}"
        some = r.only(used)
        seeds = written(some.df.distinct().withColumn(cname(row), F.monotonically_increasing_id())) if used else self.spark.range(1).select(F.col("id").alias(cname(row)))
        met = self.seeded(plan, Rel(seeds, some.vars | {row: Enc("lit", None, INTEGER)}, some.nullable), row)
        met = seeds.join(met.df.select(met.col(row)).distinct(), cname(row), "left_semi")
        keys = met.select(*[quoted(cname(v)).alias(f"k_{cname(v)}") for v in used], F.lit(True).alias(cname(flag)))
        on = reduce(lambda a, b: a & b, [r.col(v).eqNullSafe(quoted(f"k_{cname(v)}")) for v in used], F.lit(True))
        df = r.df.join(keys, on, "left").select(*[r.col(v) for v in r.vars], quoted(cname(flag)))
        return Rel(df, r.vars | mark, r.nullable | {flag}), there

    def seeded(self, plan: object, seed: Rel, row: str) -> Rel:
        """Solutions of the plan for each row of seed, whose variables are in scope at every level, as
        if they were written in place of the variables. Each solution has its seed's number."""
        outer = visible(seed)
        if not correlated(plan, outer):
            return join(seed, self.lower(plan))
        match plan:
            case Filter():
                r = self.seeded(plan.input, seed, row)
                for e in conjuncts(plan.expr):
                    names, x = list(r.vars), self.with_exists(r, e)
                    r = Rel(x.df.where(X.ebv(compile_expr(e, x.scope(), self.c))), dict(x.vars), set(x.nullable)).only(names)
                return r
            case Extend():
                r = self.seeded(plan.input, seed, row)
                if plan.var in r.vars:
                    raise ValueError(f"?{plan.var} is bound already")
                names, r = list(r.vars), self.with_exists(r, plan.expr)
                x = compile_expr(plan.expr, r.scope(), self.c)
                df = r.df.select(*[r.col(v) for v in names], computed(x, plan.expr).alias(cname(plan.var)))
                return Rel(df, {v: r.vars[v] for v in names} | {plan.var: x.enc}, (r.nullable & set(names)) | {plan.var})
            case Join():
                return join(self.seeded(plan.left, seed, row), self.seeded(plan.right, seed, row))
            case Union():
                return union([self.seeded(x, seed, row) for x in plan.parts])
            case LeftJoin():
                return self.optional(self.seeded(plan.left, seed, row), self.seeded(plan.right, seed, row), plan.expr)
            case Minus():  # what is written in place of a variable is none that both sides share
                left, right = self.seeded(plan.left, seed, row), self.seeded(plan.right, seed, row)
                right = right.only([row, *(v for v in right.vars if v in left.vars and v not in outer and v != row)])
                shared = [v for v in right.vars if v != row]
                if not shared:
                    return left
                both = lambda scope: reduce(lambda a, b: a | b, [left.col(v).isNotNull() & quoted(f"r_{cname(v)}").isNotNull() for v in shared])
                return join(left, right, "left_anti", both)
        raise ValueError(f"EXISTS with outer variables in {type(plan).__name__}")

    def left_join(self, p: LeftJoin) -> Rel:
        return self.optional(self.lower(p.left), self.lower(p.right), p.expr)

    def optional(self, left: Rel, right: Rel, e: object | None) -> Rel:
        if self.opt_plus:  # every left solution also by itself
            inner = join(left, right, "inner", None if e is None else lambda scope: F.coalesce(X.ebv(compile_expr(e, scope, self.c)), F.lit(False)))
            return union([left, inner])
        if e is None:
            return join(left, right, "left") if not left.unit or right.vars else left
        if exists_in(e):
            return self.left_join_exists(left, right, e)
        return join(left, right, "left", lambda scope: F.coalesce(X.ebv(compile_expr(e, scope, self.c)), F.lit(False)))

    def left_join_exists(self, left: Rel, right: Rel, e: object) -> Rel:
        """The expression needs whole solutions: those that meet it, and the left ones of which none does."""
        numbered = written(left.df.withColumn(cname("!row"), F.monotonically_increasing_id()))
        left = Rel(numbered, dict(left.vars) | {"!row": Enc("lit", None, INTEGER)}, set(left.nullable))
        both = join(left, right)
        names = list(both.vars)
        flagged = self.with_exists(both, e)
        met = Rel(flagged.df.where(X.ebv(compile_expr(e, flagged.scope(), self.c))), dict(flagged.vars), set(flagged.nullable)).only(names)
        met = Rel(written(met.df), dict(met.vars), set(met.nullable))
        rest = Rel(left.df.join(met.df.select(cname("!row")).distinct(), cname("!row"), "left_anti"), dict(left.vars), set(left.nullable))
        names.remove("!row")
        return union([met.only(names), rest.only([v for v in left.vars if v != "!row"])], names)

    def service(self, p: Service) -> Rel:
        """A registered name, or the address of an endpoint, which gets the group as one query. A
        failure, when planned or run, gives one solution without bindings if it is silent."""
        try:
            if not isinstance(p.name, Term):
                raise ValueError(f"no service {p.name}")
            sources = self.services.get(p.name.v)
            if sources is None:
                if self.at is None or not p.name.v.startswith("http"):
                    raise ValueError(f"no service {p.name.v}")
                sources = [self.at(f"sparql@{p.name.v}")]
            if len(sources) == 1 and hasattr(sources[0], "whole"):
                return sources[0].whole(p.input)
            r = Lowering(self.spark, sources, self.c, self.services, at=self.at).lower(p.input)
            return Rel(written(r.df), dict(r.vars), set(r.nullable)) if p.silent and r.vars else r  # what fails when it runs fails here
        except Exception as e:
            if p.silent:
                return self.unit()
            raise ValueError(f"service {p.name}: {str(e)[:500]}") from e

    def order(self, p: OrderBy) -> Rel:
        r = self.lower(p.input)
        keys, names = [], list(r.vars)
        for e, descending in p.keys:
            r = self.with_exists(r, e)
            k = X.order_column(compile_expr(e, r.scope(), self.c))
            keys.append(k.desc_nulls_last() if descending else k.asc_nulls_first())
        out = Rel(r.df.orderBy(*keys), dict(r.vars), set(r.nullable))
        return out if len(names) == len(r.vars) else out.only(names)

    def group(self, p: Group) -> Rel:
        r = self.lower(p.input)
        if not p.aggregates:
            df = r.df.select(*[r.col(v) for v in p.keys]).distinct()
            return Rel(df, {v: r.vars[v] for v in p.keys}, r.nullable & set(p.keys))
        aggs, finish, encs = [], {}, {}
        for name, a in p.aggregates:
            r = self.with_exists(r, a.arg)
            made = None
            if isinstance(a.arg, Call) and (x := compile_expr(a.arg, r.scope(), self.c)).t == "term" and x.const is None:
                made = f"!arg{len(encs)}"  # computed once a row, below the aggregation
                df = r.df.select(*[r.col(v) for v in r.vars], computed(x, a.arg).alias(cname(made)))
                r = Rel(df, r.vars | {made: Enc("term")}, r.nullable | {made})
            col, enc = self.aggregate(r, a, f"a_{len(encs)}", aggs, made)
            finish[name], encs[name] = col, enc
        keys = [v for v in p.keys if v in r.vars]
        df = r.df.groupBy(*[r.col(v) for v in keys]).agg(*aggs) if keys else r.df.agg(*aggs)
        df = df.select(*[quoted(cname(v)) for v in keys], *[c.alias(cname(n)) for n, c in finish.items()])
        return Rel(df, {v: r.vars[v] for v in keys} | encs, (r.nullable & set(keys)) | set(encs)).filled([*p.keys, *encs])

    def aggregate(self, r: Rel, a: Aggregate, tag: str, aggs: list[Column], made: str | None = None) -> tuple[Column, Enc]:
        """Adds what is needed to aggs; returns the column made from it afterwards. An error of the
        expression (not an unbound variable) makes the result unbound, but for COUNT."""

        def add(c: Column) -> Column:
            name = f"{tag}_{len(aggs)}"
            aggs.append(c.alias(name))
            return F.col(name)

        if a.name == "COUNT" and a.arg is None:
            if not a.distinct:
                return add(F.count(F.lit(1))), Enc("lit", None, INTEGER)
            every = F.struct(*[r.col(v).alias(f"c{i}") for i, v in enumerate(sorted(visible(r)))]) if visible(r) else F.lit(1)
            return add(F.count_distinct(every)), Enc("lit", None, INTEGER)
        x = compile_expr(a.arg, r.scope(), self.c) if made is None else Val(r.col(made), "term")
        if a.name == "COUNT":
            return add(F.count_distinct(x.col) if a.distinct else F.count(x.col)), Enc("lit", None, INTEGER)
        poison = None
        if not isinstance(a.arg, (Var, Const)):
            bound = F.lit(True)
            for v in sorted(expr_vars(a.arg)):
                bound = bound & (r.col(v).isNotNull() if v in r.vars else F.lit(False))
            poison = add(F.max(F.when(x.col.isNull() & bound, True)))
        safe = lambda c: c if poison is None else F.when(poison.isNull(), c)
        if a.name in ("SUM", "AVG"):
            return self._sum(x, a, add, safe)
        if a.name in ("MIN", "MAX"):
            f = F.min if a.name == "MIN" else F.max
            if x.t not in ("term", "iri"):
                return safe(add(f(x.col))), x.enc
            t = x.term()
            by = F.min_by if a.name == "MIN" else F.max_by
            bad = add(F.max(F.when(t["k"] != LITERAL, True)))
            return safe(F.when(bad.isNull(), add(by(t, X.sort_key(t))))), Enc("term")
        if a.name == "SAMPLE":
            return safe(add(F.min(x.col) if x.t != "term" else F.min_by(x.col, X.sort_key(x.col)))), x.enc
        if a.name == "GROUP_CONCAT":
            v = X.str_of(x)
            joined = F.array_join(F.sort_array(F.collect_set(v)), a.separator) if a.distinct else F.array_join(F.sort_array(F.collect_list(v)), a.separator)
            return safe(F.coalesce(add(joined), F.lit(""))), Enc("lit", None, STRING)
        raise ValueError(f"unknown aggregate {a.name}")

    def _sum(self, x: Val, a: Aggregate, add: Callable, safe: Callable) -> tuple[Column, Enc]:
        if x.t in X.NUMERIC:
            if a.name == "SUM":
                if x.t == "integer":
                    s = add(F.sum_distinct(x.col) if a.distinct else F.try_sum(x.col))
                    return safe(F.coalesce(s, F.lit(0).cast("bigint"))), Enc("lit", None, INTEGER)
                s = add(F.sum_distinct(x.col) if a.distinct else F.sum(x.col))
                return safe(F.coalesce(s, F.lit(0).cast(X.SPARK[x.t])).cast(X.SPARK[x.t] if x.t != "float" else "double")), Enc("lit", None, X.DT_OF[x.t if x.t != "float" else "double"])
            if x.t in ("integer", "decimal"):
                wide = x.col.cast("decimal(38,18)") if x.t == "decimal" else x.col
                s = add(F.sum_distinct(wide) if a.distinct else F.try_sum(wide))
                n = add(F.count_distinct(x.col) if a.distinct else F.count(x.col))
                mean = F.try_divide(s.cast("decimal(38,18)"), n.cast("decimal(20,0)")).cast("decimal(38,18)")
                return safe(F.coalesce(mean, F.lit(0).cast("decimal(38,18)"))), Enc("lit", None, DECIMAL)
            m = add(F.avg(x.col) if not a.distinct else F.avg(F.when(x.col.isNotNull(), x.col)))
            if a.distinct:
                s, n = add(F.sum_distinct(x.col)), add(F.count_distinct(x.col))
                m = s / n
            return safe(F.coalesce(m.cast("double"), F.lit(0.0))), Enc("lit", None, X.DOUBLE)
        t = x.term()
        number, exact, rank = X.term_number(t), X.term_decimal(t), X.term_rank(t)
        bad = add(F.max(F.when(t.isNotNull() & number.isNull(), True)))
        total = add(F.sum_distinct(number) if a.distinct else F.sum(number))
        whole = add(F.sum_distinct(exact) if a.distinct else F.try_sum(exact))
        n = add(F.count_distinct(number) if a.distinct else F.count(number))
        top = add(F.max(rank))
        if a.name == "AVG":
            total, whole, top = total / n, F.try_divide(whole, n.cast("decimal(20,0)")).cast("decimal(38,18)"), F.greatest(top, F.lit(1))
        v = F.when(top == 0, F.regexp_replace(whole.cast("string"), r"\.0*$", "")).when(top == 1, lexical(whole, DECIMAL)).otherwise(lexical(total, X.DOUBLE))
        dt = F.when(top == 0, INTEGER).when(top == 1, DECIMAL).when(top == 2, X.FLOAT).otherwise(X.DOUBLE)
        return safe(F.when(bad.isNull(), F.when(n == 0, term_col(LITERAL, F.lit("0"), F.lit(INTEGER))).otherwise(term_col(LITERAL, v, dt)))), Enc("term")


def _canonical(t: Term) -> str:
    if t.dt == INTEGER:
        return str(int(t.v))
    return ("true" if t.v in ("true", "1") else "false") if t.dt == X.BOOLEAN else t.v


def conjuncts(e: object) -> list:
    if isinstance(e, Call) and e.name == "&&":
        return [x for a in e.args for x in conjuncts(a)]
    return [e]


def computed(x: Val, e: object) -> Column:
    """A column that holds an expression's value. One of any type is made by a generator, so that
    the optimizer doesn't write it out again at each place where it is used."""
    return F.explode(F.array(x.col)) if x.t == "term" and x.const is None and isinstance(e, Call) else x.col


def exists_in(e: object) -> list[Exists]:
    if isinstance(e, Exists):
        return [e]
    return [x for a in e.args for x in exists_in(a)] if isinstance(e, Call) else []

