"""Updates over snapshots: each operation makes a new table of quads, written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.operators.lower import Lowering
from quadspark.operators.quadforms import instantiate
from quadspark.operators.scratch import written
from quadspark.plans.algebra import Update, Updates
from quadspark.sources.quads import QUADS, QuadSource, rows
from quadspark.terms import BNODE, Term


KEYS = ["s", "p", "o", "g"]
#: Changes after which the store is written anew.
COMPACT = 8


class Store:
    """A dataset that can be changed. Quads are a set (is_set: those given are one already); graphs
    may exist without quads."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, graphs: set[str] | None = None, union_default: bool = False, read_only: bool = False, is_set: bool = False) -> None:
        self.spark, self.union_default, self.read_only = spark, union_default, read_only
        given = spark.createDataFrame([], QUADS) if quads is None else quads.select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g"))
        self.quads = given if quads is None or is_set else given.distinct()
        self.graphs: set[str] = set(graphs or ())  # made, or emptied, by name
        self.emptied: DataFrame | None = None  # names (g) of graphs that were emptied together
        self.pending = 0  # changes since the store was one table

    @property
    def source(self) -> QuadSource:
        return QuadSource(self.quads, self.union_default)

    def has(self, graph: str) -> bool:
        """Whether a named graph exists: it was made, or has quads."""
        return graph in self.graphs or not self.quads.where(F.col("g") == graph).isEmpty() or self.emptied is not None and not self.emptied.where(F.col("g") == graph).isEmpty()

    def named(self) -> set[str]:
        """The names of all graphs that exist, for a caller whose store has few. Updates don't use it."""
        names = self.quads.where("g <> ''").select("g")
        return self.graphs | {r["g"] for r in (names if self.emptied is None else names.unionByName(self.emptied)).distinct().collect()}

    def empty_all(self) -> None:
        """Named graphs stay there without quads: their names are a table."""
        names = self.quads.where("g <> ''").select("g")
        self.emptied = written((names if self.emptied is None else names.unionByName(self.emptied)).distinct())

    def forget(self, graph: str | None = None) -> None:
        """A graph (None: all) doesn't exist any longer."""
        self.graphs -= {graph} if graph is not None else set(self.graphs)
        if self.emptied is not None:
            self.emptied = self.emptied.where(F.col("g") != graph) if graph is not None else None

    def keep(self, cond: Column) -> None:
        """Quads that don't meet the condition go."""
        self._now(self.quads.where(cond))

    def change(self, delete: DataFrame | None, insert: DataFrame | None) -> None:
        """Deletions come first. Only what changes is written; the rest of the store stays where
        it is, until COMPACT changes have come together."""
        if delete is not None:
            self._now(self.quads.join(written(delete.distinct()), KEYS, "left_anti"))
        if insert is not None:
            new = insert.select(*KEYS).distinct().join(self.quads, KEYS, "left_anti").select(*KEYS)
            self._now(self.quads.select(*KEYS).unionByName(written(new)))

    def _now(self, df: DataFrame) -> None:
        self.quads, self.pending = df, self.pending + 1
        if self.pending >= COMPACT:
            self.compact()

    def compact(self) -> None:
        """Writes the store as one table."""
        self.quads, self.pending = written(self.quads), 0


def run_updates(store: Store, updates: Updates, context, load: Callable[[str], DataFrame] | None = None) -> None:  # noqa: ANN001
    if store.read_only:
        raise PermissionError("the store is read only")
    for u in updates.parts:
        try:
            _run(store, u, context, load)
        except Exception:
            if not u.silent:
                raise


def _run(store: Store, u: Update, context, load) -> None:  # noqa: ANN001
    match u.kind:
        case "insert" | "delete":
            data = _ground(store.spark, u.insert or u.delete)
            store.change(data if u.kind == "delete" else None, data if u.kind == "insert" else None)
        case "modify":
            lowering = Lowering(store.spark, [store.source], context, default=u.using, named=u.using_named)
            r = lowering.lower(u.where)
            r.df = written(r.df) if r.vars else r.df  # evaluated once, before anything changes
            if any(isinstance(x, Term) and x.k == BNODE for t in u.delete for x in (t.s, t.o)):
                raise ValueError("a blank node can't be deleted")
            delete = instantiate(r, u.delete, context) if u.delete else None
            insert = instantiate(r, u.insert, context) if u.insert else None
            store.change(written(delete) if delete is not None else None, insert)
        case "load":
            if load is None:
                raise ValueError("nothing can be loaded here")
            target = "" if u.target == "DEFAULT" else u.target
            store.change(None, load(u.source).select("s", "p", "o", F.lit(target).alias("g")))
        case "clear" | "drop":
            one = u.target not in ("DEFAULT", "NAMED", "ALL")
            if one and not u.silent and not store.has(u.target):
                raise KeyError(f"no graph {u.target}")
            cond = {"DEFAULT": F.col("g") != "", "NAMED": F.col("g") == "", "ALL": F.lit(False)}.get(u.target, F.col("g") != u.target)
            if u.kind == "clear":
                if one:
                    store.graphs.add(u.target)
                elif u.target != "DEFAULT":
                    store.empty_all()
            elif one:
                store.forget(u.target)
            elif u.target != "DEFAULT":
                store.forget()
            store.keep(cond)
        case "create":
            if not u.silent and store.has(u.target):
                raise KeyError(f"graph {u.target} exists")
            store.graphs.add(u.target)
        case "add" | "copy" | "move":
            if u.source == u.target:
                return
            name = lambda t: "" if t == "DEFAULT" else t
            source, target = name(u.source), name(u.target)
            if source and not store.has(source):
                raise KeyError(f"no graph {source}")
            moved = store.quads.where(F.col("g") == source).select("s", "p", "o", F.lit(target).alias("g"))
            if u.kind != "add":
                store.keep(F.col("g") != target)
            store.change(None, moved)
            if u.kind == "move":
                store.keep(F.col("g") != source)
                store.forget(source)
        case _:
            raise ValueError(f"unknown update {u.kind}")


def run_changes(spark: SparkSession, destination, sources: list, updates: Updates, context, load) -> None:  # noqa: ANN001
    """Updates whose changes are sent elsewhere: patterns are matched in the sources."""
    for u in updates.parts:
        try:
            match u.kind:
                case "insert" | "delete":
                    data = _ground(spark, u.insert or u.delete)
                    destination.change(data if u.kind == "delete" else None, data if u.kind == "insert" else None)
                case "modify":
                    r = Lowering(spark, sources, context, default=u.using, named=u.using_named).lower(u.where)
                    r.df = written(r.df) if r.vars else r.df
                    destination.change(instantiate(r, u.delete, context) if u.delete else None, instantiate(r, u.insert, context) if u.insert else None)
                case "load":
                    destination.change(None, load(u.source).select("s", "p", "o", F.lit("" if u.target == "DEFAULT" else u.target).alias("g")))
                case _:
                    raise ValueError(f"{u.kind} can't be sent to {destination.kind} destinations")
        except Exception:
            if not u.silent:
                raise


def _ground(spark: SparkSession, template: tuple) -> DataFrame:
    return rows(spark, [(t.s, t.p.v, t.o, t.g.v if t.g is not None else "") for t in template])
