"""python -m quadspark.cli SOURCE... -q QUERY | -f FILE [-t FORMAT] [--explain MODE] [--to PATH]

SOURCE: an RDF file, folder or glob, or tables:DIR for Parquet tables as a virtual graph."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quadspark.engine import Engine
from quadspark.sources import results
from quadspark.sources.rdf_files import read_rdf


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadspark", description=__doc__)
    p.add_argument("sources", nargs="+")
    p.add_argument("-q", "--query")
    p.add_argument("-f", "--file")
    p.add_argument("-t", "--type", default=None)
    p.add_argument("-b", "--base")
    p.add_argument("--explain", choices=("parsed", "logical", "physical", "sparql"))
    p.add_argument("--to", help="write all results as lines to this folder, with Spark")
    p.add_argument("--lenient", action="store_true")
    a = p.parse_args(args)
    text = a.query or Path(a.file).read_text()
    spark = spark or SparkSession.builder.appName("quadspark").getOrCreate()
    sources, prefixes = [], {}
    for s in a.sources:
        if s.startswith("tables:"):
            e = Engine.over_tables(spark, s.removeprefix("tables:"))
            sources.append(e.sources[0])
            prefixes = e.prefixes
        else:
            sources.append(read_rdf(spark, s, base=a.base, lenient=a.lenient))
    engine = Engine(spark, *sources, prefixes=prefixes, base=a.base)
    if a.explain:
        print(engine.explain(text, a.explain))
        return 0
    kind = engine.parse(text).kind
    if kind in ("construct", "describe"):
        quads = engine.query(text)
        if a.to:
            results.write_nquads(quads, a.to)
        else:
            sys.stdout.write(results.QUAD_FORMATS[a.type or "application/trig"](quads))
    elif a.to:
        (results.write_tsv if a.type == "text/tab-separated-values" else results.write_csv)(engine.bindings(text), a.to)
    else:
        sys.stdout.write(results.BINDINGS[a.type or "application/json"](engine.query(text) if kind == "ask" else engine.bindings(text)))
    return 0



if __name__ == "__main__":
    sys.exit(main())
