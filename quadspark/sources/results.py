"""Writers of results: SPARQL JSON, XML, CSV and TSV, plain JSON, tables and trees of solutions;
N-Triples, N-Quads, Turtle, TriG and JSON-LD of quads.

Lines, Turtle and JSON-LD are written by Spark, a document for each task (write_*). The *_text functions give a whole document as one
string, for results that a driver can hold.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.terms import BNODE, BOOLEAN, DECIMAL, DOUBLE, INTEGER, IRI, LITERAL, RDF, STRING, TRIPLE, Term, n3_col


def term_of(row: object) -> Term | None:
    return None if row is None else Term(row["k"], row["v"], row["dt"], row["lang"], row["dir"])


def solutions(df: DataFrame) -> Iterable[dict[str, Term | None]]:
    for r in df.toLocalIterator():
        yield {c: term_of(r[c]) for c in df.columns}


# bindings (TERM columns, from Engine.bindings)

def _json_term(t: Term) -> dict:
    kind = {IRI: "uri", BNODE: "bnode", TRIPLE: "triple"}.get(t.k, "literal")
    out: dict = {"type": kind, "value": t.v}
    if t.k == LITERAL:
        if t.lang:
            out["xml:lang"] = t.lang
            if t.dir:
                out["its:dir"] = t.dir
        elif t.dt not in (None, STRING):
            out["datatype"] = t.dt
    return out


def sparql_json_text(df: DataFrame | bool) -> str:
    if isinstance(df, bool):
        return json.dumps({"head": {}, "boolean": df})
    rows = [{v: _json_term(t) for v, t in s.items() if t is not None} for s in solutions(df)]
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}}, ensure_ascii=False)


def sparql_xml_text(df: DataFrame | bool) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<sparql xmlns="http://www.w3.org/2005/sparql-results#">']
    if isinstance(df, bool):
        return "\n".join([*out, "  <head/>", f"  <boolean>{str(df).lower()}</boolean>", "</sparql>"])
    out += ["  <head>", *(f"    <variable name={quoteattr(v)}/>" for v in df.columns), "  </head>", "  <results>"]
    for s in solutions(df):
        out.append("    <result>")
        for v, t in s.items():
            if t is None:
                continue
            if t.k == IRI:
                body = f"<uri>{xml_escape(t.v)}</uri>"
            elif t.k == BNODE:
                body = f"<bnode>{xml_escape(t.v)}</bnode>"
            else:
                extra = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" datatype={quoteattr(t.dt)}" if t.dt not in (None, STRING) else ""
                body = f"<literal{extra}>{xml_escape(t.v)}</literal>"
            out.append(f"      <binding name={quoteattr(v)}>{body}</binding>")
        out.append("    </result>")
    return "\n".join([*out, "  </results>", "</sparql>"])


def _csv_cell(t: Column) -> Column:
    v = F.when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).otherwise(t["v"])
    return F.coalesce(F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))).otherwise(v), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[_csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    def cell(t: Column) -> Column:
        bare = (t["k"] == LITERAL) & ((t["dt"] == INTEGER) & t["v"].rlike(r"^[+-]?[0-9]+$") | (t["dt"] == DECIMAL) & t["v"].rlike(r"^[+-]?[0-9]*\.[0-9]+$") | (t["dt"] == DOUBLE) & t["v"].rlike(r"^[+-]?[0-9.]+[eE][+-]?[0-9]+$"))
        return F.coalesce(F.when(bare, t["v"]).otherwise(n3_col(t)), F.lit(""))

    return df.select(F.concat_ws("\t", *[cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def csv_text(df: DataFrame) -> str:
    return "\r\n".join([",".join(df.columns), *(r["value"] for r in csv_lines(df).toLocalIterator())]) + "\r\n"


def tsv_text(df: DataFrame) -> str:
    return "\n".join(["\t".join("?" + c for c in df.columns), *(r["value"] for r in tsv_lines(df).toLocalIterator())]) + "\n"


def plain_json_text(df: DataFrame | bool) -> str:
    if isinstance(df, bool):
        return json.dumps(df)
    return json.dumps([{v: t.n3() for v, t in s.items() if t is not None} for s in solutions(df)], ensure_ascii=False)


def simple_text(df: DataFrame | bool) -> str:
    if isinstance(df, bool):
        return f"{str(df).lower()}\n"
    return "\n".join("\n".join(f"?{v}: {t.v if t is not None else ''}" for v, t in s.items()) + "\n" for s in solutions(df))


def table_text(df: DataFrame | bool, width: int = 24) -> str:
    if isinstance(df, bool):
        return f"{str(df).lower()}\n"
    cut = lambda x: (x[: width - 1] + "…" if len(x) > width else x).ljust(width)
    lines = [" ".join(cut(c) for c in df.columns), "-" * (len(df.columns) * (width + 1) - 1)]
    return "\n".join([*lines, *(" ".join(cut(t.v if t is not None else "") for t in s.values()) for s in solutions(df))]) + "\n"


def tree_text(df: DataFrame, singular: set[str] = frozenset()) -> str:
    """Solutions as nested objects: names with _ are paths; a value is a list unless its name is singular."""
    out: list[dict] = []
    for s in solutions(df):
        root: dict = {}
        for v, t in s.items():
            if t is None:
                continue
            *path, last = v.split("_")
            at = root
            for p in path:
                at = at.setdefault(p, [{}])[0]
            at.setdefault(last, []).append(t.v)
        out.append(root)

    def shape(x: object, name: str = "") -> object:
        if isinstance(x, dict):
            return {k: shape(v, f"{name}_{k}".strip("_")) for k, v in x.items()}
        items = [shape(y, name) for y in x] if isinstance(x, list) else x
        return items[0] if isinstance(x, list) and name in singular and items else items

    return json.dumps([shape(x) for x in out], ensure_ascii=False)


def stats_text(df: DataFrame) -> str:
    """When each result came, in milliseconds."""
    import time

    start, lines = time.monotonic(), ["Result,Delay (ms)"]
    n = 0
    for n, _ in enumerate(df.toLocalIterator(), 1):
        lines.append(f"{n},{(time.monotonic() - start) * 1000:.3f}")
    return "\n".join([*lines, f"TOTAL,{(time.monotonic() - start) * 1000:.3f}", f"COUNT,{n}"]) + "\n"


# quads

def nquads_lines(quads: DataFrame) -> DataFrame:
    g = F.when(F.col("g") != "", F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("")
    return quads.select(F.concat(n3_col(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), n3_col(F.col("o")), g, F.lit(" .")).alias("value"))


def write_nquads(quads: DataFrame, path: str) -> None:
    nquads_lines(quads).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    csv_lines(df).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_lines(df).write.text(path)


def _short(prefixes: dict[str, str] | None):
    """IRIs in N-Triples form to prefixed names, where one fits."""
    known = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def name(n3: str) -> str:
        if n3.startswith("<") and not n3.startswith("<<"):
            for p, u in known:
                rest = n3[1:-1].removeprefix(u)
                if n3[1:-1].startswith(u) and rest.replace("_", "a").replace("-", "a").isalnum():
                    return f"{p}:{rest}"
        return n3

    return name


#: Tasks among which quads are dealt before their ranges are found, at most.
SPREAD = 96


def _sorted_quads(quads: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Quads of one graph and subject one after the other. Ranges of them are the tasks: a subject
    of very many quads may be in several, and no task holds one whole."""
    key = [F.coalesce("g", F.lit("")).alias("g"), n3_col(F.col("s")).alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), n3_col(F.col("o")).alias("o"), F.struct("s", "o").alias("t")]
    if rows_per_task is None:
        ranged = quads.select(*key).repartitionByRange("g", "s", "p", "o")
    else:
        tasks = max(1, quads.count() // rows_per_task)
        # the ranges are found by samples that every task holds in memory: three of a hundred rows a range, shared among the tasks
        spread = quads.repartition(min(SPREAD, tasks // 8 + 1), "s", "p", "o")
        ranged = spread.select(*key).repartitionByRange(tasks, "g", "s", "p", "o")
    return ranged.sortWithinPartitions("g", "s", "p", "o")


def turtle_lines(quads: DataFrame, prefixes: dict[str, str] | None = None, rows_per_task: int | None = None) -> DataFrame:
    """(value): lines of Turtle, or of TriG where there are named graphs; the lines of each
    partition are a document by themselves."""
    name = _short(prefixes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = subject = None
        lines = [f"@prefix {p}: <{u}> ." for p, u in sorted((prefixes or {}).items())]
        for b in batches:
            for g, s, p, o in zip(b["g"], b["s"], b["p"], b["o"], strict=True):
                if (g, s) != (graph, subject):
                    if subject is not None:
                        lines.append("  .")
                    if g != graph:
                        if graph:
                            lines.append("}")
                        if g:
                            lines.append(f"<{g}> {{")
                    lines.append(f"{name(s)} {name(p)} {name(o)}")
                    graph, subject = g, s
                else:
                    lines.append(f"  ; {name(p)} {name(o)}")
            yield pd.DataFrame({"value": lines})
            lines = []
        if subject is not None:
            yield pd.DataFrame({"value": ["  .", *(["}"] if graph else [])]})

    return _sorted_quads(quads, rows_per_task).select("g", "s", "p", "o").mapInPandas(run, "value string")


def write_turtle(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None, rows_per_task: int | None = None) -> None:
    """A folder of documents, written by many tasks."""
    turtle_lines(quads, prefixes, rows_per_task).write.text(path)


#: Values of one node object; a subject with more has several objects with one @id, which is the same.
NODE_VALUES = 1000


def jsonld_lines(quads: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """(value): lines of JSON-LD; those of each partition are a document by themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, node, size, first = None, {}, 0, True

        def close() -> str:
            nonlocal first
            whole = {"@id": key[0], "@graph": [node]} if key[0] else node
            text = ("" if first else ",") + json.dumps(whole, ensure_ascii=False)
            first = False
            return text

        opened = False
        for b in batches:
            lines = [] if opened else ["["]
            opened = True
            for g, p, t in zip(b["g"], b["p"], b["t"], strict=True):
                s, o = term_of(t["s"]), term_of(t["o"])
                if (g, s) != key or size >= NODE_VALUES:
                    if key is not None:
                        lines.append(close())
                    key, node, size = (g, s), {"@id": _ident(s)}, 0
                size += 1
                if p == f"<{RDF}type>":
                    node.setdefault("@type", []).append(_ident(o))
                else:
                    node.setdefault(p[1:-1], []).append(_json_value(o))
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": [*([close()] if key is not None else [] if opened else ["["]), "]"]})

    return _sorted_quads(quads, rows_per_task).select("g", "p", "t").mapInPandas(run, "value string")


def write_jsonld(quads: DataFrame, path: str, rows_per_task: int | None = None) -> None:
    """A folder of documents, written by many tasks."""
    jsonld_lines(quads, rows_per_task).write.text(path)


def _ident(t: Term) -> str:
    return f"_:{t.v}" if t.k == BNODE else t.v


def _json_value(t: Term) -> dict:
    if t.k in (IRI, BNODE):
        return {"@id": _ident(t)}
    if t.lang:
        return {"@value": t.v, "@language": t.lang} | ({"@direction": t.dir} if t.dir else {})
    if t.dt in (None, STRING):
        return {"@value": t.v}
    if t.dt == BOOLEAN and t.v in ("true", "false"):
        return {"@value": t.v == "true"}
    return {"@value": t.v, "@type": t.dt}


def ntriples_text(quads: DataFrame) -> str:
    return "".join(r["value"] + "\n" for r in nquads_lines(quads.withColumn("g", F.lit(""))).toLocalIterator())


def nquads_text(quads: DataFrame) -> str:
    return "".join(r["value"] + "\n" for r in nquads_lines(quads).toLocalIterator())


def turtle_text(quads: DataFrame, prefixes: dict[str, str] | None = None, trig: bool = True) -> str:
    """Subjects with their predicates and objects; named graphs in braces."""
    short = _short(prefixes)
    name = lambda n3: "a" if n3 == f"<{RDF}type>" else short(n3)
    graphs: dict[str, dict[str, dict[str, list[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in quads.toLocalIterator():
        graphs[r["g"] or ""][term_of(r["s"]).n3()][f"<{r['p']}>"].append(term_of(r["o"]).n3())
    out = [f"@prefix {p}: <{u}> ." for p, u in sorted((prefixes or {}).items())]
    for g, subjects in graphs.items():
        pad = "  " if g and trig else ""
        if pad:
            out.append(f"<{g}> {{")
        for s, ps in subjects.items():
            body = f" ;\n{pad}    ".join(f"{name(p)} {', '.join(map(name, os))}" for p, os in ps.items())
            out.append(f"{pad}{name(s) if name(s) != 'a' else s} {body} .")
        if pad:
            out.append("}")
    return "\n".join(out) + "\n"


def jsonld_text(quads: DataFrame) -> str:
    graphs: dict[str, dict[str, dict]] = defaultdict(dict)
    for r in quads.toLocalIterator():
        s, o = term_of(r["s"]), term_of(r["o"])
        node = graphs[r["g"] or ""].setdefault(_ident(s), {"@id": _ident(s)})
        if r["p"] == RDF + "type":
            node.setdefault("@type", []).append(_ident(o))
        else:
            node.setdefault(r["p"], []).append(_json_value(o))
    out = list(graphs.pop("", {}).values())
    out += [{"@id": g, "@graph": list(nodes.values())} for g, nodes in graphs.items()]
    return json.dumps(out, ensure_ascii=False)


def shaclc_text(quads: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    """Shapes in compact syntax."""
    from quadspark.sources.shaclc import shaclc_text as write

    return write([(term_of(r["s"]), r["p"], term_of(r["o"]), r["g"]) for r in quads.toLocalIterator()], prefixes)


BINDINGS = {
    "application/sparql-results+json": sparql_json_text, "application/sparql-results+xml": sparql_xml_text, "text/csv": csv_text, "text/tab-separated-values": tsv_text, "application/json": plain_json_text, "simple": simple_text, "table": table_text,
    "tree": tree_text, "stats": stats_text,
}
QUAD_FORMATS = {"application/n-triples": ntriples_text, "application/n-quads": nquads_text, "text/turtle": turtle_text, "application/trig": turtle_text, "text/n3": turtle_text, "application/ld+json": jsonld_text}
