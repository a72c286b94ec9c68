"""Relational tables as a virtual RDF graph.

A row is a subject, whose IRI is a template with the row's key; each column is a predicate with
the native value as its literal; a foreign key is also a link to the other row's IRI; the table
is its class, and a named graph. A star of patterns over one table is one scan of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.operators.relation import Rel, cname, table_bytes, union
from quadspark.plans.algebra import TripleTerm, Var
from quadspark.terms import DATETIME, INTEGER, IRI, LITERAL, NUMERIC_TYPES, RDF, TERM_DDL, Enc, Term, box, datatype_of, term_col

TYPE = RDF + "type"


@dataclass(frozen=True)
class TableMap:
    """key: columns that identify a row, none: all of them. links: predicate -> (column, other table)."""

    name: str
    key: tuple[str, ...] = ()
    links: dict[str, tuple[str, str]] = field(default_factory=dict)


#: The test tables.
TPCH = (
    TableMap("region", ("r_regionkey",)),
    TableMap("nation", ("n_nationkey",), {"regionRef": ("n_regionkey", "region")}),
    TableMap("customer", ("c_custkey",), {"nationRef": ("c_nationkey", "nation")}),
    TableMap("supplier", ("s_suppkey",), {"nationRef": ("s_nationkey", "nation")}),
    TableMap("part", ("p_partkey",)),
    TableMap("orders", ("o_orderkey",), {"custRef": ("o_custkey", "customer")}),
    TableMap("lineitem", (), {"orderRef": ("l_orderkey", "orders"), "partRef": ("l_partkey", "part"), "suppRef": ("l_suppkey", "supplier")}),
    TableMap("events", ("event_id",)),
    TableMap("documents", ("doc_id",)),
    TableMap("embeddings", ("vec_id",)),
    TableMap("labels", ("doc_id",), {"docRef": ("doc_id", "documents")}),
    TableMap("pages", ("page_id",)),
    TableMap("benchmark", ("item_id",)),
    TableMap("conversations", ("conv_id", "turn")),
)


class TableSource:
    """load: table name -> DataFrame. Only the tables that a query uses are loaded."""

    def __init__(self, load: Callable[[str], DataFrame], maps: tuple[TableMap, ...] = TPCH, base: str = "http://tpch/", rows: dict[str, float] | None = None) -> None:
        self.load, self.maps, self.base = load, {m.name: m for m in maps}, base
        self.cache: dict[str, DataFrame] = {}
        self.sizes: dict[str, float] = dict(rows or {})
        self.known: dict[str, dict[str, tuple[str, Enc]]] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = self.load(name)
        return self.cache[name]

    def template(self, table: str) -> str:
        return f"{self.base}{table}/"

    def key(self, m: TableMap) -> Column:
        df = self.frame(m.name)
        if len(m.key) == 1:
            k = F.col(m.key[0])
            return k.cast("bigint") if datatype_of(df.schema[m.key[0]].dataType) in NUMERIC_TYPES else k
        if m.key:
            return F.concat_ws("/", *[F.col(c).cast("string") for c in m.key])
        return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f.name).cast("string"), F.lit("\x00")) for f in df.schema]), 256)

    def predicates(self, m: TableMap) -> dict[str, tuple[str, Enc]]:
        """Predicate IRI -> the name of its column, and how it is encoded."""
        if m.name not in self.known:
            out = {}
            for f in self.frame(m.name).schema:
                dt = datatype_of(f.dataType)
                if dt is not None:
                    out[f"{self.base}{m.name}#{f.name}"] = (f.name, Enc("lit", None, dt))
            for p, (c, other) in m.links.items():
                out[f"{self.base}{m.name}#{p}"] = (c, Enc("iri", self.template(other), INTEGER))
            self.known[m.name] = out
        return self.known[m.name]

    def column(self, m: TableMap, name: str, enc: Enc) -> Column:
        """Integers as bigint, timestamps without a zone."""
        col, t = F.col(name), self.frame(m.name).schema[name].dataType.simpleString()
        want = {DATETIME: "timestamp_ntz", INTEGER: "bigint"}.get(enc.dt)
        return col if want in (None, t) else col.cast(want)

    def graph_iri(self, table: str) -> str:
        return f"{self.base}graph/{table}"

    def _tables(self, s: object, pairs: list[tuple[object, object]], g: object) -> list[TableMap]:
        """Those that can have all of the patterns."""
        left = list(self.maps.values())
        for p, o in pairs:
            if isinstance(p, Term):
                if p.v == TYPE and isinstance(o, Term):
                    left = [m for m in left if o.v == f"{self.base}{m.name}"]
                elif p.v != TYPE:
                    table, _, name = p.v.removeprefix(self.base).partition("#")
                    left = [m for m in left if p.v.startswith(self.base) and m.name == table and name]
        if isinstance(s, Term):
            left = [m for m in left if s.k == IRI and s.v.startswith(self.template(m.name))]
        if isinstance(g, Term):
            left = [m for m in left if g.v == self.graph_iri(m.name)]
        if isinstance(g, frozenset):
            left = [m for m in left if self.graph_iri(m.name) in g]
        return left

    def can_be(self, m: TableMap, subject: Enc) -> bool:
        """Whether a row of the table can have an IRI that is encoded so."""
        if subject.kind == "term" or subject.kind == "iri" and subject.template is None:
            return True
        mine, other = self.template(m.name), subject.template or ""
        if subject.kind != "iri" or mine == other:
            return subject.kind == "iri"
        return mine.startswith(other) and subject.dt != INTEGER or other.startswith(mine)

    def star(self, s: object, pairs: list[tuple[object, object]], g: object, subject: Enc | None = None) -> Rel:
        """subject: the encoding of what s will be joined to, so that tables of other IRIs are left out."""
        tables = [m for m in self._tables(s, pairs, g) if subject is None or self.can_be(m, subject)]
        names = list(dict.fromkeys(x.name for x in [s, *(y for pair in pairs for y in pair), g] if isinstance(x, Var)))
        parts = [r for m in tables if (r := self._scan(m, s, pairs, g)) is not None]
        if not parts:
            spark = self.frame(next(iter(self.maps))).sparkSession
            empty = spark.createDataFrame([], ", ".join(f"`{cname(v)}` {TERM_DDL}" for v in names) or "x int")
            return Rel(empty.select(*[f"`{cname(v)}`" for v in names]), {v: Enc("term") for v in names})
        return parts[0] if len(parts) == 1 else union(parts, names)

    def rows(self, name: str) -> float:
        """An estimate from the size of the table's files; rows given to the source come first."""
        if name not in self.sizes:
            df = self.frame(name)
            width = sum(16 if isinstance(f.dataType, T.StringType) else 5 for f in df.schema)
            self.sizes[name] = max(1.0, table_bytes(df) / width)
        return self.sizes[name]

    def estimate(self, s: object, pairs: list[tuple[object, object]], g: object) -> tuple[float, dict[str, float]]:
        """Rows of a star, and different values of its variables: keys and links are known by
        the tables they belong to."""
        total, values = 0.0, {}
        for m in self._tables(s, pairs, g):
            all_rows = n = self.rows(m.name)
            kinds: dict[str, float] = {s.name: all_rows} if isinstance(s, Var) else {}
            if isinstance(s, Term):
                n = 1.0
            for p, o in pairs:
                link = m.links.get(p.v.rpartition("#")[2]) if isinstance(p, Term) else None
                known = self.rows(link[1]) if link else max(2.0, all_rows / 10)
                if not isinstance(p, Term):
                    n *= len(self.predicates(m)) + 1
                elif p.v == TYPE:
                    known = 1.0
                if isinstance(o, Term):
                    n /= known if link else 1.0 if known == 1.0 else 10.0
                for v in (o,) if isinstance(o, Var) else ():
                    kinds.setdefault(v.name, known)
            total += n
            for v, k in kinds.items():
                values[v] = values.get(v, 0.0) + min(k, all_rows)
        return total, values

    def _scan(self, m: TableMap, s: object, pairs: list[tuple[object, object]], g: object) -> Rel | None:
        """One scan of one table; None if it has no such row."""
        known, df = self.predicates(m), self.frame(m.name)
        columns: dict[str, tuple[Column, Enc]] = {}
        cond: list[Column] = []
        exploded = 0

        def place(x: object, col: Column, enc: Enc) -> bool:
            if isinstance(x, Var):
                if x.name in columns:
                    other, kind = columns[x.name]
                    cond.append(other == col if kind == enc else box(other, kind) == box(col, enc))
                else:
                    columns[x.name] = (col, enc)
                return True
            if isinstance(x, TripleTerm):
                return False
            found = constant_match(x, col, enc)
            if found is None:
                return False
            cond.append(found)
            return True

        key = self.key(m)
        whole = len(m.key) == 1 and datatype_of(df.schema[m.key[0]].dataType) in NUMERIC_TYPES
        if not place(s, key, Enc("iri", self.template(m.name), INTEGER if whole else None)):
            return None
        for p, o in pairs:
            if isinstance(p, Term):
                if p.v == TYPE:
                    if not place(o, F.lit(f"{self.base}{m.name}"), Enc("iri", None)):
                        return None
                    continue
                if p.v not in known:
                    return None
                name, enc = known[p.v]
                col = self.column(m, name, enc)
                cond.append(col.isNotNull())
                if not place(o, col, enc):
                    return None
                continue
            # a variable predicate: the row's columns one below the other
            every = [F.struct(F.lit(iri).alias("p"), box(self.column(m, c, e), e).alias("o")) for iri, (c, e) in known.items()]
            every.append(F.struct(F.lit(TYPE).alias("p"), term_col(IRI, F.lit(f"{self.base}{m.name}")).alias("o")))
            name = f"__po{exploded}"
            exploded += 1
            df = df.withColumn(name, F.explode(F.array(*every))).where(F.col(f"{name}.o").isNotNull())
            if not place(p, F.col(f"{name}.p"), Enc("iri", None)) or not place(o, F.col(f"{name}.o"), Enc("term")):
                return None
        if isinstance(g, Var) and not place(g, F.lit(self.graph_iri(m.name)), Enc("iri", None)):
            return None
        for c in cond:
            df = df.where(c)
        return Rel(df.select(*[c.alias(cname(v)) for v, (c, _) in columns.items()]), {v: e for v, (_, e) in columns.items()})

    def pattern(self, t) -> Rel:  # noqa: ANN001
        return self.star(t.s, [(t.p, t.o)], t.g)

    def nodes(self, g: object) -> DataFrame:
        s, p, o = Var("s"), Var("p"), Var("o")
        r = self.star(s, [(p, o)], g).boxed({"s", "o"})
        extra = [r.col(g.name).alias("g")] if isinstance(g, Var) else []
        return r.df.select(r.col("s").alias("n"), *extra).union(r.df.select(r.col("o").alias("n"), *extra)).distinct()

    def quads(self, tables: list[str] | None = None, named: bool = True) -> DataFrame:
        """The tables as a DataFrame of quads, each in its graph (or all in the default graph)."""
        parts = []
        for name in tables or list(self.maps):
            r = self.star(Var("s"), [(Var("p"), Var("o"))], Term(IRI, self.graph_iri(name))).boxed({"s", "o"})
            parts.append(r.df.select(r.col("s").alias("s"), r.col("p").alias("p"), r.col("o").alias("o"), F.lit(self.graph_iri(name) if named else "").alias("g")))
        return reduce(DataFrame.union, parts)


def constant_match(t: Term, col: Column, enc: Enc) -> Column | None:
    """Whether a column holds the constant; None if it can't."""
    from quadspark.functions.expr import constant

    if enc.kind == "term":
        from quadspark.sources.quads import matches

        return matches(col, t)
    if enc.kind == "iri":
        if t.k != IRI:
            return None
        if enc.template is None:
            return col == F.lit(t.v)
        if not t.v.startswith(enc.template):
            return None
        key = t.v[len(enc.template) :]
        if key.lstrip("-").isdigit() and len(key) < 19:  # an integer key's IRI has no leading zeros
            return col == F.lit(int(key)) if str(int(key)) == key else None
        return col.cast("string") == key
    if t.k != LITERAL or t.dt != enc.dt:
        return None
    v = constant(t)
    return None if v.t == "term" else col == v.col

