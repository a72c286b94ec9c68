"""Sources and destinations over HTTP, against servers on this machine."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from quadspark.engine import Engine
from quadspark.operators.update import Store
from quadspark.server import serve
from quadspark.sources import web
from quadspark.sources.rdf_files import from_text

DATA = [(f"http://x/s{i}", f"http://x/p{i % 2}", f"http://x/o{i % 5}") for i in range(23)]
HYDRA = "http://www.w3.org/ns/hydra/core#"


class Stub(BaseHTTPRequestHandler):
    """Fragments of DATA in pages of four; documents; a document that takes PATCH; a place for PUT."""

    asked: list = []
    busy = 0

    def reply(self, code, body="", kind="text/turtle", **headers):
        self.send_response(code)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body.encode())), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body.encode())

    def do_GET(self):
        url = urlsplit(self.path)
        args = {k: v[0] for k, v in parse_qs(url.query).items()}
        here = f"http://127.0.0.1:{self.server.server_address[1]}"
        Stub.asked.append(self.path)
        if url.path == "/busy" and Stub.busy < 2:
            Stub.busy += 1
            return self.reply(503, Retry_After="0")
        if url.path == "/busy":
            return self.reply(200, "<http://x/a> <http://x/b> 1 .")
        if url.path == "/doc1":
            return self.reply(200, f"<http://x/a> <http://x/b> <http://x/c> . <> <{HYDRA}next> <doc2> .")
        if url.path == "/doc2":
            return self.reply(200, '{"@id": "http://x/c", "http://x/b": {"@id": "http://x/d"}}', "application/ld+json", Link='<doc3>; rel="next"')
        if url.path == "/doc3":
            return self.reply(200, "<http://x/d> <http://x/b> <http://x/e> .\n", "application/octet-stream")
        if url.path == "/described":
            return self.reply(200, f"<> a <http://www.w3.org/ns/sparql-service-description#Service> ; <http://www.w3.org/ns/sparql-service-description#endpoint> <{Stub.endpoint}> .")
        if url.path != "/tpf":
            return self.reply(404, Allow="GET, PUT")
        found = [t for t in DATA if all(args.get(k) in (None, v) for k, v in zip("spo", t, strict=True))]
        page = int(args.get("page", 0))
        rest = "&".join(f"{k}={v}" for k, v in args.items() if k != "page")
        more = f"<> <{HYDRA}next> <{here}/tpf?{rest}&page={page + 1}> ." if (page + 1) * 4 < len(found) else ""
        lines = "".join(f"<{s}> <{p}> <{o}> . " for s, p, o in found[page * 4 : page * 4 + 4])
        form = " , ".join(f'[ <{HYDRA}variable> "{v}" ; <{HYDRA}property> <http://www.w3.org/1999/02/22-rdf-syntax-ns#{n}> ]' for v, n in (("s", "subject"), ("p", "predicate"), ("o", "object")))
        meta = f'<{here}/tpf#meta> {{ <{here}/tpf#meta> <http://xmlns.com/foaf/0.1/primaryTopic> <> . <> <http://rdfs.org/ns/void#triples> {len(found)} . {more} <{here}/tpf> <{HYDRA}search> [ <{HYDRA}template> "{here}/tpf{{?s,p,o}}" ; <{HYDRA}mapping> {form} ] . }}'
        return self.reply(200, lines + meta, "application/trig")

    def do_HEAD(self):
        self.reply(*(200, ""), Accept_Patch="application/sparql-update") if self.path == "/patch" else self.reply(404)

    def do_OPTIONS(self):
        self.reply(200, Allow="GET, PUT")

    def body(self):
        Stub.asked.append((self.command, self.path, self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
        self.reply(204)

    do_PUT = do_PATCH = body

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


@pytest.fixture
def endpoint(spark):
    store = Store(spark, from_text(spark, "<http://x/a> <http://x/b> 1 , 2 . <http://x/c> <http://x/b> 3 ; <http://x/n> 'x'@en . _:q <http://x/b> 4 . <http://x/g> { <http://x/c> <http://x/in> 'g' }", "application/trig"))
    server = serve(Engine(spark, store), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/sparql"
    Stub.endpoint = url
    yield url, store
    server.shutdown()


def test_documents_and_their_pages(spark, stub):
    e = Engine(spark, f"{stub}/doc1", prefixes={"": "http://x/"})
    assert [tuple(r) for r in e.query("SELECT ?x { :a :b/:b/:b ?x }").collect()] == [("http://x/e",)]
    assert Engine(spark, f"{stub}/busy").query("SELECT ?x { ?s ?p ?x }").count() == 1  # asked again when busy
    with pytest.raises(OSError):
        Engine(spark, f"{stub}/nothing").query("SELECT ?x { ?s ?p ?x }")
    with pytest.raises(PermissionError):
        Engine(spark, f"{stub}/doc1", remote=False).query("SELECT ?x { ?s ?p ?x }")


def test_fragments(spark, stub):
    e = Engine(spark, f"{stub}/tpf", prefixes={"": "http://x/"})
    got = {tuple(r) for r in e.query("SELECT ?s ?o { ?s :p1 ?o }").collect()}
    assert got == {(s, o) for s, p, o in DATA if p.endswith("p1")}
    assert e.query("SELECT ?s { ?s :p0 :o2 }").count() == sum(p.endswith("p0") and o.endswith("o2") for _, p, o in DATA)
    assert any("o=http%3A%2F%2Fx%2Fo2" in x for x in Stub.asked if isinstance(x, str))  # constants go with the request
    assert e.query("SELECT * { ?s ?p ?o }").count() == len(DATA)  # what describes the fragment isn't data
    assert e.query("SELECT ?a ?b { ?a :p0 ?o . ?b :p1 ?o }").count() == sum(x[2] == y[2] for x in DATA for y in DATA if x[1].endswith("p0") and y[1].endswith("p1"))


def test_endpoints(spark, stub, endpoint):
    url, _ = endpoint
    for address in (url, f"sparql@{url}", f"{stub}/described"):
        e = Engine(spark, address, prefixes={"": "http://x/"})
        assert sorted(r.x for r in e.query("SELECT ?x { ?s :b ?x }").collect()) == ["1", "2", "3", "4"]
    assert e.query("SELECT ?v { ?s :n ?v ; :b ?x FILTER(LANG(?v) = 'en' && ?x = 3) }").count() == 1
    assert [tuple(r) for r in e.query("SELECT ?g ?v { GRAPH ?g { ?s :in ?v } }").collect()] == [("http://x/g", "g")]
    assert e.query("SELECT ?x { :a :b* ?x }").count() == 3
    local = Engine(spark, from_text(spark, "<http://x/c> <http://x/k> 9 ."), prefixes={"": "http://x/"})
    assert [tuple(r) for r in local.query(f"SELECT ?k ?v {{ ?s :k ?k SERVICE <{url}> {{ ?s :b ?v OPTIONAL {{ ?s :none ?z }} }} }}").collect()] == [("9", "3")]
    assert local.query("SELECT ?k { ?s :k ?k SERVICE SILENT <http://127.0.0.1:9/sparql> { ?s :b ?v } }").count() == 1
    with pytest.raises(Exception, match="127.0.0.1:9"):
        local.query("SELECT ?k { ?s :k ?k SERVICE <http://127.0.0.1:9/sparql> { ?s :b ?v } }")


def test_solutions_go_with_the_next_request(spark, endpoint, monkeypatch):
    url, _ = endpoint
    sent = []
    run = web.EndpointSource.run
    monkeypatch.setattr(web.EndpointSource, "run", lambda self, bodies, names: sent.append(bodies) or run(self, bodies, names))
    e = Engine(spark, url, prefixes={"": "http://x/"})
    assert [tuple(r) for r in e.query("SELECT ?o ?v { ?s :n ?v . ?t :b ?o FILTER(?s = ?t) } ").collect()] == [("3", "x")]
    assert [r.v for r in e.query("SELECT ?v { ?s :b 3 . ?s :n ?v . GRAPH ?g { ?s :in ?w } }").collect()] == ["x"]
    assert any(b[0].startswith("VALUES (?s) { (<http://x/c>)") for b in sent)


def test_updates(spark, stub, endpoint):
    url, store = endpoint
    e = Engine(spark, store, prefixes={"": "http://x/"}, destination=web.Destination(url))
    e.update("INSERT DATA { :new :b 7 } ; DELETE WHERE { :a :b ?x }")
    assert {r.x for r in Engine(spark, store, prefixes={"": "http://x/"}).query("SELECT ?x { ?s :b ?x }").collect()} == {"3", "4", "7"}
    Stub.asked.clear()
    e = Engine(spark, store, prefixes={"": "http://x/"}, destination=web.Destination(f"{stub}/patch"))
    e.update("DELETE { ?s :b 3 } INSERT { ?s :b 'three' } WHERE { ?s :b 3 }")
    sent = [x for x in Stub.asked if isinstance(x, tuple)]
    assert [x[:3] for x in sent] == [("PATCH", "/patch", "application/sparql-update")] * 2 and "DELETE DATA" in sent[0][3] and 'INSERT DATA { <http://x/c> <http://x/b> "three" . }' == sent[1][3]
    put = web.Destination(f"{stub}/fresh")
    assert put.kind == "put"
    Stub.asked.clear()
    Engine(spark, store, prefixes={"": "http://x/"}, destination=put).update("INSERT DATA { :a :b 'c' }")
    assert Stub.asked == [("PUT", "/fresh", "text/turtle", '<http://x/a> <http://x/b> "c" .')]
    with pytest.raises(ValueError):
        Engine(spark, store, destination=put).update("CLEAR ALL")
