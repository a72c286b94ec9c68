"""A SPARQL protocol endpoint over an engine: python -m quadspark.server SOURCE... [-p PORT].

GET and POST /sparql with query= or update=; the Accept header chooses the format. Results are
written as one document, so it is meant for answers that a driver can hold."""

from __future__ import annotations

import argparse
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from quadspark.engine import Engine
from quadspark.operators.update import Store
from quadspark.plans.parser import ParseError
from quadspark.sources import results
from quadspark.sources.rdf_files import read_rdf


def choose(accept: str, offered: list[str]) -> str | None:
    """The offered type with the highest quality; the first one for */*."""
    best, score = None, 0.0
    for part in (accept or "*/*").split(","):
        kind, *more = (x.strip() for x in part.split(";"))
        q = next((float(x[2:]) for x in more if x.startswith("q=")), 1.0)
        for o in offered:
            if q > score and (kind in (o, "*/*") or kind.endswith("/*") and o.startswith(kind[:-1])):
                best, score = o, q
                break
    return best


def answer(engine: Engine, query: str, accept: str) -> tuple[str, str]:
    """(type, text)"""
    q = engine.parse(query)
    if q.kind in ("construct", "describe"):
        kind = choose(accept, ["application/n-quads", *results.QUAD_FORMATS])
        if kind is None:
            raise LookupError("no such format")
        return kind, results.QUAD_FORMATS[kind](engine.query(query))
    offered = [k for k in results.BINDINGS if "/" in k]
    kind = choose(accept, offered)
    if kind is None:
        raise LookupError("no such format")
    if q.kind == "ask":
        if kind not in ("application/sparql-results+json", "application/sparql-results+xml", "application/json"):
            kind = offered[0]
        return kind, results.BINDINGS[kind](engine.ask(q))
    return kind, results.BINDINGS[kind](engine.bindings(query))


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, kind: str, text: str) -> None:
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def run(self, args: dict[str, list[str]], body: str = "", body_type: str = "") -> None:
            query = args.get("query", [None])[0] or (body if body_type == "application/sparql-query" else None)
            update = args.get("update", [None])[0] or (body if body_type == "application/sparql-update" else None)
            try:
                if update:
                    engine.update(update)
                    self.reply(204, "text/plain", "")
                elif query:
                    self.reply(200, *answer(engine, query, self.headers.get("Accept", "")))
                else:
                    self.reply(400, "text/plain", "a query or an update is needed")
            except ParseError as e:
                self.reply(400, "text/plain", str(e))
            except PermissionError as e:
                self.reply(403, "text/plain", str(e))
            except LookupError as e:
                self.reply(406, "text/plain", str(e))
            except Exception as e:
                self.reply(500, "text/plain", str(e)[:2000])

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path.rstrip("/") not in ("", "/sparql"):
                self.reply(404, "text/plain", "see /sparql")
                return
            args = parse_qs(url.query)
            args.pop("update", None)  # a GET changes nothing
            self.run(args)

        do_HEAD = do_GET

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            kind = self.headers.get("Content-Type", "").split(";")[0].strip()
            args = parse_qs(urlsplit(self.path).query)
            self.run(args | parse_qs(body) if kind == "application/x-www-form-urlencoded" else args, body, kind)

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 3000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(engine))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadspark-server", description=__doc__)
    p.add_argument("sources", nargs="+")
    p.add_argument("-p", "--port", type=int, default=3000)
    p.add_argument("-u", "--update", action="store_true", help="sources become a store that can be changed")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quadspark-server").getOrCreate()
    if a.sources[0].startswith("tables:"):
        engine = Engine.over_tables(spark, a.sources[0].removeprefix("tables:"))
    else:
        quads = read_rdf(spark, a.sources)
        engine = Engine(spark, Store(spark, quads) if a.update else quads, load=lambda s: read_rdf(spark, s))
    serve(engine, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
