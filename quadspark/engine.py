"""The engine: queries and updates over sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from quadspark.functions.expr import Context
from quadspark.operators.lower import Lowering
from quadspark.operators.quadforms import describe, instantiate
from quadspark.operators.relation import Rel
from quadspark.operators.update import Store, run_changes, run_updates
from quadspark.plans.algebra import Query, bind_initial
from quadspark.plans.parser import parse_query, parse_update
from quadspark.sources.quads import QuadSource
from quadspark.sources.rdf_files import read_rdf
from quadspark.sources.virtual import TPCH, TableSource
from quadspark.sources.web import Destination, identify, read_documents
from quadspark.terms import Term, box, value


class Engine:
    """sources: TableSource, QuadSource, Store, DataFrames of quads, or addresses (http: documents,
    fragments and endpoints, also as sparql@http://...). A query sees them together.
    destination: of updates, if it isn't a Store among the sources (sources.web.Destination).
    remote: SERVICE, FROM a source's address and LOAD may ask other servers; headers go with requests.

    services: name -> list of sources, for SERVICE. extensions: IRI -> function of columns;
    extension_creator: makes one by its IRI, or None. opt_plus: OPTIONAL also keeps each left
    solution by itself. non_lexical_comparison: ill-typed literals of one datatype compare by text.
    """

    def __init__(
        self, spark: SparkSession, *sources: object, prefixes: dict[str, str] | None = None, base: str | None = None, services: dict[str, list] | None = None, extensions: dict[str, Callable[..., Column]] | None = None, union_default_graph: bool = False,
        distinct_construct: bool = False, full_term_comparison: bool = False, non_lexical_comparison: bool = False, extension_creator: Callable[[str], Callable[..., Column] | None] | None = None, opt_plus: bool = False, reserved_in_encode: bool = False, now: str | None = None, load: Callable[[str], DataFrame] | None = None,
        destination: Destination | None = None, remote: bool = True, headers: dict[str, str] | None = None,
    ) -> None:
        self.spark, self.prefixes, self.base, self.union_default = spark, prefixes or {}, base, union_default_graph
        self.sources, self.services = list(sources), services or {}
        self.extensions, self.distinct_construct, self.full, self.reserved, self.now, self.load = extensions or {}, distinct_construct, full_term_comparison, reserved_in_encode, now, load
        self.destination, self.remote, self.headers = destination, remote, headers
        self.found: dict[str, object] = {}  # sources by address
        self.lexical_comparison, self.creator, self.opt_plus = non_lexical_comparison, extension_creator, opt_plus

    @classmethod
    def over_tables(cls, spark: SparkSession, sf_dir: str, **options) -> Engine:  # noqa: ANN003
        """The test tables as a virtual graph, with prefixes of the tables' names."""
        prefixes = {m.name: f"http://tpch/{m.name}#" for m in TPCH} | {"t": "http://tpch/", "g": "http://tpch/graph/", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
        return cls(spark, TableSource(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")), prefixes=prefixes, **options)

    def _sources(self) -> list:
        out = []
        for s in self.sources:
            out.append(self.at(s) if isinstance(s, str) else s.source if isinstance(s, Store) else QuadSource(s, self.union_default) if isinstance(s, DataFrame) else s)
        return out

    def at(self, address: str) -> object:
        """The source at an address, identified once."""
        if not self.remote:
            raise PermissionError(f"no requests are made: {address}")
        if address not in self.found:
            self.found[address] = identify(self.spark, address, self.headers)
        return self.found[address]

    def _context(self, base: str | None) -> Context:
        c = Context(base=base or self.base, extensions=self.extensions, full_comparison=self.full, lexical_comparison=self.lexical_comparison, creator=self.creator, reference_encoding=self.reserved)
        if self.now:
            c.now = self.now
        return c

    def parse(self, text: str) -> Query:
        return parse_query(text, self.base, self.prefixes)

    def lowering(self, q: Query) -> Lowering:
        return Lowering(self.spark, self._sources(), self._context(q.base), self.services, q.from_default, q.from_named, self.opt_plus, self.at)

    def relation(self, q: Query, initial: dict[str, Term] | None = None) -> Rel:
        return self.lowering(q).lower(bind_initial(q.plan, initial or {}))

    def query(self, text: str, initial: dict[str, Term] | None = None) -> DataFrame | bool:
        """SELECT: a DataFrame with a column for each variable: native values where the type is
        known, else IRIs and lexical forms as strings. ASK: a boolean. CONSTRUCT, DESCRIBE: quads."""
        q = self.parse(text)
        if q.kind == "ask":
            return self.ask(q, initial)
        if q.kind in ("construct", "describe"):
            return self.quads(q, initial)
        r = self.relation(q, initial)
        return r.df.select(*[value(r.col(v), r.vars[v]).alias(v) for v in q.vars])

    def bindings(self, text: str, initial: dict[str, Term] | None = None) -> DataFrame:
        """SELECT, with every variable as a TERM struct (k, v, dt, lang, dir)."""
        q = self.parse(text)
        r = self.relation(q, initial)
        return r.df.select(*[box(r.col(v), r.vars[v]).alias(v) for v in q.vars])

    def ask(self, q: Query | str, initial: dict[str, Term] | None = None) -> bool:
        q = self.parse(q) if isinstance(q, str) else q
        return not self.relation(q, initial).df.isEmpty()

    def quads(self, q: Query | str, initial: dict[str, Term] | None = None) -> DataFrame:
        q = self.parse(q) if isinstance(q, str) else q
        low = self.lowering(q)
        r = low.lower(bind_initial(q.plan, initial or {}))
        if q.kind == "describe":
            return describe(low, r, q.template)
        return instantiate(r, q.template, low.c, self.distinct_construct)

    def update(self, text: str) -> None:
        store = next((s for s in self.sources if isinstance(s, Store)), None)
        u = parse_update(text, self.base, self.prefixes)
        load = self.load or (lambda s: read_documents(self.spark, [s], headers=self.headers) if self.remote and s.startswith("http") else read_rdf(self.spark, s.removeprefix("file://")))
        if self.destination is not None:
            if self.destination.kind == "sparql":
                names = "".join(f"PREFIX {p}: <{i}> " for p, i in self.prefixes.items())
                self.destination.send((f"BASE <{self.base}> " if self.base else "") + names + text)
            else:
                run_changes(self.spark, self.destination, self._sources(), u, self._context(u.base), load)
            return
        if store is None:
            raise PermissionError("no source can be changed")
        run_updates(store, u, self._context(u.base), load)

    def explain(self, text: str, mode: str = "physical") -> str:
        """mode: parsed (the plan that was read), logical (its operators), physical (Spark's plan)."""
        q = self.parse(text)
        if mode == "parsed":
            return repr(q)
        if mode == "logical":
            from quadspark.plans.serialize import outline

            return outline(q.plan)
        if mode == "sparql":
            from quadspark.plans.serialize import to_sparql

            return to_sparql(q)
        df = self.quads(q) if q.kind in ("construct", "describe") else self.relation(q).df
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
