"""Sources and destinations over HTTP: RDF documents with their pages, triple pattern fragments and
SPARQL endpoints; updates by SPARQL, PATCH and PUT.

Requests run in tasks on the executors, and what they return is written to the shared folder
once, so that a plan may read it as often as it likes and a failed request fails the planning.
"""

from __future__ import annotations

import gzip
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.operators.relation import Rel, cname, join
from quadspark.operators.scratch import written
from quadspark.plans.algebra import Bgp, Pattern, Var, in_scope, node_vars
from quadspark.plans.serialize import node, pattern
from quadspark.sources.quads import QUADS, QuadSource
from quadspark.sources.rdf_text import EXTENSIONS, parse
from quadspark.terms import BNODE, IRI, RDF, TERM_DDL, Enc, Term, literal, n3_col, triple

#: Names that descriptions of sources use.
HYDRA, VOID, SD, FOAF = "http://www.w3.org/ns/hydra/core#", "http://rdfs.org/ns/void#", "http://www.w3.org/ns/sparql-service-description#", "http://xmlns.com/foaf/0.1/"
RDF_TYPES = "application/trig;q=1,application/n-quads;q=0.9,text/turtle;q=0.8,application/n-triples;q=0.7,application/ld+json;q=0.6,application/rdf+xml;q=0.5,text/html;q=0.2"
TRIES, TIMEOUT, MOST_PAGES = 3, 60, 100_000
#: Solutions that are sent to an endpoint with a pattern, at most, and how many with one request.
BIND_ROWS, BIND_AT_ONCE = 2_000, 64


@dataclass
class Reply:
    status: int
    url: str
    headers: dict[str, str]
    body: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("content-type", "").partition(";")[0].strip().lower()

    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


def fetch(url: str, accept: str = RDF_TYPES, method: str = "GET", data: bytes | None = None, headers: dict[str, str] | None = None, tries: int = TRIES, timeout: float = TIMEOUT) -> Reply:
    """One request; it is repeated when the server is busy or can't be reached. An error status raises."""
    all_headers = {"Accept": accept, "Accept-Encoding": "gzip", "User-Agent": "quadspark"} | (headers or {})
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, all_headers, method=method), timeout=timeout) as r:
                got = {k.lower(): v for k, v in r.headers.items()}
                body = r.read()
                return Reply(r.status, r.url, got, gzip.decompress(body) if got.get("content-encoding") == "gzip" else body)
        except urllib.error.HTTPError as e:
            if e.code not in (429, 502, 503, 504) or not left:
                raise OSError(f"{method} {url}: {e.code} {e.read()[:500].decode('utf-8', 'replace')}") from None
            wait = e.headers.get("Retry-After", "")
        except urllib.error.URLError as e:
            if not left:
                raise OSError(f"{method} {url}: {e.reason}") from None
            wait = ""
        time.sleep(min(30.0, float(wait) if wait.isdigit() else 0.2 * (tries - left)))
    raise OSError(url)


def document(reply: Reply, media_type: str | None = None) -> list[tuple[Term, str, Term, str]]:
    """Quads of a reply: by its type, else by the address's extension, else as Turtle."""
    kind = media_type or reply.kind
    if kind not in {*EXTENSIONS.values(), "application/trig", "application/xhtml+xml"}:
        kind = EXTENSIONS.get(urllib.parse.urlsplit(reply.url).path.rpartition(".")[2].lower(), "text/turtle")
    return parse(reply.text(), kind, reply.url)


def _cells(ts: list[Term | None]) -> pd.Series:
    return pd.Series([None if t is None else {"k": t.k, "v": t.v, "dt": t.dt, "lang": t.lang, "dir": t.dir} for t in ts], dtype=object)


def _quads(found: list[tuple[Term, str, Term, str]]) -> pd.DataFrame:
    return pd.DataFrame({"s": _cells([q[0] for q in found]), "p": pd.Series([q[1] for q in found], dtype=object), "o": _cells([q[2] for q in found]), "g": pd.Series([q[3] for q in found], dtype=object)})


@dataclass
class Description:
    """What a document says of itself: its next page, a search form, a count, an endpoint."""

    next: str | None = None
    template: str | None = None
    fields: dict[str, str] = field(default_factory=dict)  # subject, predicate, object, graph -> name in the template
    count: float | None = None
    endpoint: str | None = None
    graph: str | None = None  # that holds the description


def describe(reply: Reply, quads: list[tuple[Term, str, Term, str]]) -> Description:
    out = Description()
    by: dict[tuple[Term, str], list[Term]] = {}
    for s, p, o, g in quads:
        by.setdefault((s, p), []).append(o)
        if p in (HYDRA + "next", HYDRA + "nextPage"):
            out.next = urllib.parse.urljoin(reply.url, o.v)
        elif p in (VOID + "triples", HYDRA + "totalItems") and o.v.replace(".", "", 1).isdigit():
            out.count = float(o.v)
        elif p == SD + "endpoint":
            out.endpoint = urllib.parse.urljoin(reply.url, o.v)
        elif p == FOAF + "primaryTopic" and g:
            out.graph = g
    for (_, p), forms in list(by.items()):
        for form in forms if p == HYDRA + "search" else ():
            template = by.get((form, HYDRA + "template"), [])
            names = {by.get((m, HYDRA + "property"), [Term(IRI, "")])[0].v: by.get((m, HYDRA + "variable"), [Term(IRI, "")])[0].v for m in by.get((form, HYDRA + "mapping"), [])}
            places = {"subject": RDF + "subject", "predicate": RDF + "predicate", "object": RDF + "object", "graph": SD + "graph"}
            fields = {k: names[v] for k, v in places.items() if v in names}
            if template and len(fields) >= 3:
                out.template, out.fields = urllib.parse.urljoin(reply.url, template[0].v), fields
    if m := re.search(r'<([^>]*)>\s*;[^,]*rel="?next"?', reply.headers.get("link", "")):
        out.next = out.next or urllib.parse.urljoin(reply.url, m[1])
    return out


def _pages(keep: Callable | None, media_type: str | None, headers: dict[str, str] | None):
    """Quads of each address and of the pages that follow it, without what describes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for url in b["url"]:
                at, seen = url, set()
                while at and at not in seen and len(seen) < MOST_PAGES:
                    seen.add(at)
                    reply = fetch(at, headers=headers)
                    found = document(reply, media_type)
                    about = describe(reply, found)
                    own = [q for q in found if q[3] != about.graph or about.graph is None]
                    yield _quads([(*q[:3], "") if keep and q[3] == about.graph else q for q in own if keep is None or keep(q)])
                    at = about.next

    return run


def read_documents(spark: SparkSession, urls: list[str], media_type: str | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """Quads of documents and their pages, each address a task."""
    addresses = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return written(addresses.mapInPandas(_pages(None, media_type, headers), QUADS))


class FragmentSource:
    """A server of triple (or quad) pattern fragments: a request for each pattern and its pages."""

    def __init__(self, spark: SparkSession, about: Description, headers: dict[str, str] | None = None) -> None:
        self.spark, self.about, self.headers = spark, about, headers
        self.known: dict[str, DataFrame] = {}

    def address(self, t: Pattern) -> str:
        values = {}
        for place, x in (("subject", t.s), ("predicate", t.p), ("object", t.o), ("graph", t.g)):
            if isinstance(x, Term) and place in self.about.fields and x.k != BNODE:
                values[self.about.fields[place]] = x.v if x.k == IRI else x.n3()

        def expand(m: re.Match) -> str:
            names = [n.rstrip("*") for n in m[2].split(",")]
            pairs = [f"{n}={urllib.parse.quote(values[n], safe='')}" for n in names if n in values]
            if m[1] in ("?", "&"):
                return m[1] + "&".join(pairs) if pairs else ""
            return ",".join(urllib.parse.quote(values.get(n, ""), safe="") for n in names)

        return re.sub(r"\{([?&]?)([^}]*)\}", expand, self.about.template or "")

    def estimate(self, s: object, pairs: list[tuple[object, object]], g: object) -> tuple[float, dict[str, float]]:
        """The server's own counts."""
        counts = []
        for p, o in pairs:
            reply = fetch(self.address(Pattern(s, p, o, g)), headers=self.headers)
            counts.append(describe(reply, document(reply)).count or 1e4)
        return max(1.0, min(counts)), {s.name: max(1.0, min(counts))} if isinstance(s, Var) else {}

    def pattern(self, t: Pattern) -> Rel:
        url = self.address(t)
        if url not in self.known:
            constant = [(i, x) for i, x in enumerate((t.s, t.p, t.o)) if isinstance(x, Term)]
            keep = lambda q: all((q[i] if i != 1 else Term(IRI, q[1])) == x for i, x in constant)
            found = self.spark.createDataFrame([(url,)], "url string").mapInPandas(_pages(keep, None, self.headers), QUADS)
            self.known[url] = written(found)
        return QuadSource(self.known[url]).pattern(t)

    def star(self, s: object, pairs: list[tuple[object, object]], g: object) -> Rel:
        out = None
        for p, o in pairs:
            r = self.pattern(Pattern(s, p, o, g))
            out = r if out is None else join(out, r)
        return out

    def nodes(self, g: object) -> DataFrame:
        r = self.pattern(Pattern(Var("s"), Var("p"), Var("o"), g)).boxed({"s", "o"})
        return r.df.select(r.col("s").alias("n")).union(r.df.select(r.col("o").alias("n"))).distinct()


def json_term(x: dict, scope: str) -> Term:
    """A term of SPARQL's JSON results."""
    kind = x["type"]
    if kind == "uri":
        return Term(IRI, x["value"])
    if kind == "bnode":
        return Term(BNODE, scope + x["value"])
    if kind == "triple":
        v = x["value"]
        return triple(*(json_term(v[k], scope) for k in ("subject", "predicate", "object")))
    return literal(x["value"], x.get("datatype"), x.get("xml:lang"), x.get("its:dir"))


def _select(names: list[str], headers: dict[str, str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, (url, query) in enumerate(zip(b["url"], b["query"], strict=True)):
                form = urllib.parse.urlencode({"query": query}).encode()
                reply = fetch(url, "application/sparql-results+json,application/json;q=0.9", "POST", form, {"Content-Type": "application/x-www-form-urlencoded"} | (headers or {}))
                rows = json.loads(reply.text())["results"]["bindings"]
                for low in range(0, len(rows), 10_000):
                    piece = rows[low : low + 10_000]
                    yield pd.DataFrame({cname(n): _cells([json_term(r[n.replace(".", "__")], f"e{i}x") if n.replace(".", "__") in r else None for r in piece]) for n in names} if names else {"x": [1] * len(piece)})

    return run


class EndpointSource:
    """A SPARQL endpoint. A star, or a whole SERVICE group, is one query there."""

    def __init__(self, spark: SparkSession, url: str, headers: dict[str, str] | None = None) -> None:
        self.spark, self.url, self.headers = spark, url, headers

    def run(self, bodies: list[str], names: list[str]) -> Rel:
        """Solutions of some group patterns together, each a request of its own."""
        texts = [f"SELECT {' '.join('?' + n.replace('.', '__') for n in names) or '*'} WHERE {{ {b} }}" for b in bodies]
        asked = self.spark.createDataFrame([(self.url, t) for t in texts], "url string, query string").repartition(min(64, max(1, len(texts))))
        schema = ", ".join(f"`{cname(n)}` {TERM_DDL}" for n in names) or "x long"
        df = written(asked.mapInPandas(_select(names, self.headers), schema))
        return Rel(df if names else df.select(), {n: Enc("term") for n in names}, set(names))

    def whole(self, plan: object) -> Rel:
        return self.run([pattern(plan)], in_scope(plan))

    def body(self, s: object, pairs: list[tuple[object, object]], g: object) -> tuple[str, list[str]]:
        if isinstance(g, frozenset):
            parts = [Bgp(tuple(Pattern(s, p, o, Term(IRI, x)) for p, o in pairs)) for x in sorted(g)]
            text = " UNION ".join(f"{{ {pattern(b)} }}" for b in parts) or "FILTER(false)"
        else:
            text = pattern(Bgp(tuple(Pattern(s, p, o, g) for p, o in pairs)))
        names = sorted(node_vars(s) | node_vars(g) | set().union(*(node_vars(p) | node_vars(o) for p, o in pairs)))
        return text, names

    def star(self, s: object, pairs: list[tuple[object, object]], g: object) -> Rel:
        text, names = self.body(s, pairs, g)
        r = self.run([text], names)
        return Rel(r.df, r.vars)  # patterns bind all of their variables

    def bound_star(self, left: Rel, s: object, pairs: list[tuple[object, object]], g: object) -> Rel | None:
        """The star for the solutions found so far, which go with the request; None if they are
        many, or can't be named there."""
        text, names = self.body(s, pairs, g)
        shared = [n for n in names if n in left.vars and n not in left.nullable]
        if not shared:
            return None
        keys = left.only(shared).boxed(set(shared)).df.distinct().select(*[F.when(F.col(f"`{cname(n)}`.k") != BNODE, n3_col(F.col(f"`{cname(n)}`"))).alias(f"c{i}") for i, n in enumerate(shared)]).limit(BIND_ROWS + 1).collect()
        if len(keys) > BIND_ROWS or any(v is None for k in keys for v in k):
            return None
        head = " ".join("?" + n.replace(".", "__") for n in shared)
        bodies = [f"VALUES ({head}) {{ {' '.join('(' + ' '.join(k) + ')' for k in keys[i : i + BIND_AT_ONCE])} }} {text}" for i in range(0, len(keys), BIND_AT_ONCE)]
        r = self.run(bodies or [f"{text} FILTER(false)"], names)
        return Rel(r.df, r.vars)

    def estimate(self, s: object, pairs: list[tuple[object, object]], g: object) -> tuple[float, dict[str, float]]:
        """Unknown without asking: constants make it smaller."""
        rows = min(1e6 * (0.01 if isinstance(o, Term) else 1.0) for _, o in pairs) * (0.001 if isinstance(s, Term) else 1.0)
        return max(1.0, rows), {}

    def pattern(self, t: Pattern) -> Rel:
        return self.star(t.s, [(t.p, t.o)], t.g)

    def nodes(self, g: object) -> DataFrame:
        graph = isinstance(g, Var)
        place = f"GRAPH {node(g)}" if isinstance(g, (Var, Term)) else ""
        r = self.run([f"{place} {{ {{ ?n ?p ?o }} UNION {{ ?s ?p ?n }} }}"], ["n", *([g.name] if graph else [])])
        return r.df.select(r.col("n").alias("n"), *([r.col(g.name)["v"].alias("g")] if graph else [])).distinct()


def identify(spark: SparkSession, address: str, headers: dict[str, str] | None = None) -> object:
    """The source at an address. A kind before it (sparql@, qpf@, file@) is taken as said; else
    the document there tells: a service description, a search form, or just its quads and pages."""
    kind, at, url = address.partition("@") if re.match(r"(sparql|qpf|brtpf|file|hypermedia)@", address) else ("", "", address)
    if kind == "sparql" or not kind and urllib.parse.urlsplit(url).path.rstrip("/").endswith("/sparql"):
        return EndpointSource(spark, url, headers)
    if kind == "file":
        return QuadSource(read_documents(spark, [url], headers=headers))
    reply = fetch(url, headers=headers)
    if reply.kind.startswith("application/sparql-results"):
        return EndpointSource(spark, url, headers)
    about = describe(reply, document(reply))
    if about.endpoint and kind not in ("qpf", "brtpf"):
        return EndpointSource(spark, about.endpoint, headers)
    if about.template:
        return FragmentSource(spark, about, headers)
    if kind in ("qpf", "brtpf"):
        raise ValueError(f"no search form at {url}")
    return QuadSource(read_documents(spark, [url], headers=headers))


class Destination:
    """Where updates go over HTTP. kind: sparql (an endpoint gets the update's text), patch (changes
    are sent as SPARQL to a document) or put (a new document). None: as the server says."""

    #: Quads that one request holds.
    AT_ONCE = 1000

    def __init__(self, url: str, kind: str | None = None, headers: dict[str, str] | None = None) -> None:
        self.url, self.headers = url, headers or {}
        self.kind = kind or self.detect()

    def detect(self) -> str:
        if urllib.parse.urlsplit(self.url).path.rstrip("/").endswith("/sparql"):
            return "sparql"
        try:
            reply, exists = fetch(self.url, method="HEAD", headers=self.headers, tries=1), True
            told = reply.headers
        except OSError:
            told, exists = {k.lower(): v for k, v in fetch(self.url, method="OPTIONS", headers=self.headers, tries=1).headers.items()}, False
        if "application/sparql-update" in told.get("accept-patch", ""):
            return "patch"
        if "PUT" in told.get("allow", "") and not exists:
            return "put"
        raise ValueError(f"no way to change {self.url}")

    def send(self, text: str) -> None:
        """An update's text."""
        fetch(self.url, "*/*", "PATCH" if self.kind == "patch" else "POST", text.encode(), {"Content-Type": "application/sparql-update"} | self.headers)

    def change(self, delete: DataFrame | None, insert: DataFrame | None) -> None:
        if self.kind == "put":
            if delete is not None and not delete.isEmpty():
                raise ValueError("a new document can't lose quads")
            lines = [_line(r) for r in insert.toLocalIterator()] if insert is not None else []
            fetch(self.url, "*/*", "PUT", "\n".join(lines).encode(), {"Content-Type": "application/n-quads" if any(r.count(" <") > 2 for r in lines) else "text/turtle"} | self.headers)
            return
        for df, word in ((delete, "DELETE DATA"), (insert, "INSERT DATA")):
            held: list[str] = []
            for r in df.toLocalIterator() if df is not None else ():
                held.append(_ground(r))
                if len(held) == self.AT_ONCE:
                    self.send(f"{word} {{ {' '.join(held)} }}")
                    held = []
            if held:
                self.send(f"{word} {{ {' '.join(held)} }}")


def _terms(r: object) -> tuple[str, str, str]:
    cell = lambda t: Term(t["k"], t["v"], t["dt"], t["lang"], t["dir"]).n3()
    return cell(r["s"]), f"<{r['p']}>", cell(r["o"])


def _line(r: object) -> str:
    return " ".join(_terms(r)) + (f" <{r['g']}> ." if r["g"] else " .")


def _ground(r: object) -> str:
    text = " ".join(_terms(r)) + " ."
    return f"GRAPH <{r['g']}> {{ {text} }}" if r["g"] else text
