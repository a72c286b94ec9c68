"""Parsers and writers of RDF and results, updates, paths, GraphQL, explain, streams, plans."""

import json

import pytest
from pyspark.sql import functions as F

from quadspark.engine import Engine
from quadspark.operators.update import Store
from quadspark.plans.algebra import in_scope
from quadspark.plans.graphql import parse_graphql
from quadspark.plans.parser import ParseError, parse_query
from quadspark.plans.serialize import to_sparql
from quadspark.sources import results
from quadspark.sources.quads import QuadSource, rows
from quadspark.sources.rdf_files import from_text, read_bad_lines, read_column, read_rdf
from quadspark.sources.rdf_text import parse
from quadspark.sources.virtual import TableSource
from quadspark.terms import iri, literal

PEOPLE = """@prefix : <http://x/> . @prefix foaf: <http://xmlns.com/foaf/0.1/> .
:Alice a :Person ; foaf:name "Alice", "Alicia"@es ; foaf:knows :Bob ; :age 30 ; :list (1 2.5 "x") .
:Bob a :Person ; foaf:name "Bob" ; :knows2 [ foaf:name "Anon" ] . # end
"""


def n3(quads):
    return {(s.n3(), p, o.n3(), g) for s, p, o, g in quads}


def test_turtle():
    got = n3(parse(PEOPLE, "text/turtle"))
    assert ("<http://x/Alice>", "http://x/age", '"30"^^<http://www.w3.org/2001/XMLSchema#integer>', "") in got
    assert ("<http://x/Alice>", "http://xmlns.com/foaf/0.1/name", '"Alicia"@es', "") in got
    assert len(got) == 5 + 1 + 6 + 3 + 1 + 0


def test_trig_and_nquads():
    trig = "PREFIX : <http://x/> :s :p :o . :g { :a :b 'c' . :a :b 1.0 } GRAPH :h { :d :e true }"
    got = n3(parse(trig, "application/trig"))
    assert ("<http://x/a>", "http://x/b", '"c"', "http://x/g") in got and len(got) == 4
    nq = '<http://x/a> <http://x/b> "q \\"uo\\" te"@en <http://x/g> .\n# note\n_:n <http://x/b> <http://x/c> .\n'
    got = n3(parse(nq, "application/n-quads"))
    assert ("<http://x/a>", "http://x/b", '"q \\"uo\\" te"@en', "http://x/g") in got and len(got) == 2
    with pytest.raises(ParseError):
        parse("<http://x/a> nonsense", "application/n-triples")


def test_jsonld():
    doc = {"@context": {"name": "http://x/name", "ex": "http://x/", "knows": {"@id": "ex:knows", "@type": "@id"}, "tags": {"@id": "ex:tags", "@container": "@list"}}, "@id": "ex:a", "@type": "ex:P", "name": ["A", {"@value": "B", "@language": "de"}], "knows": "ex:b", "tags": [1, 2], "ex:ok": True, "ex:half": 0.5}
    got = n3(parse(json.dumps(doc), "application/ld+json"))
    assert {("<http://x/a>", "http://x/name", '"B"@de', ""), ("<http://x/a>", "http://x/knows", "<http://x/b>", "")} <= got
    assert ("<http://x/a>", "http://x/half", '"5.0E-1"^^<http://www.w3.org/2001/XMLSchema#double>', "") in got and len(got) == 11


def test_rdfxml():
    doc = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><x:P rdf:about="http://x/a" x:k="v"><x:n xml:lang="en">A</x:n><x:l rdf:resource="http://x/b"/>
      <x:d rdf:datatype="http://www.w3.org/2001/XMLSchema#int">4</x:d><x:r rdf:parseType="Resource"><x:q>1</x:q></x:r><x:c rdf:parseType="Collection"><rdf:Description rdf:about="http://x/m"/></x:c></x:P></rdf:RDF>"""
    got = n3(parse(doc, "application/rdf+xml"))
    assert {("<http://x/a>", "http://x/n", '"A"@en', ""), ("<http://x/a>", "http://x/k", '"v"', ""), ("<http://x/a>", "http://x/l", "<http://x/b>", "")} <= got and len(got) == 10


def test_html():
    page = """<html><head><script type="application/ld+json">{"@id": "http://x/a", "http://x/p": "v"}</script><script type="application/ld+json">{broken</script><script>var a;</script></head>
      <body vocab="http://schema.org/"><div itemscope itemtype="http://schema.org/Person" itemid="http://x/i"><span itemprop="name">Al</span><a itemprop="url" href="/u">u</a></div>
      <p about="http://x/r" typeof="Book"><b property="title">T &amp; t</b></p></body></html>"""
    got = n3(parse(page, "text/html", "http://h/"))
    assert {("<http://x/a>", "http://x/p", '"v"', ""), ("<http://x/i>", "http://schema.org/name", '"Al"', ""), ("<http://x/i>", "http://schema.org/url", "<http://h/u>", ""), ("<http://x/r>", "http://schema.org/title", '"T & t"', "")} <= got


def test_files(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://x/a> <http://x/p> "v\\n1"@en .\n_:b <http://x/p> <http://x/a> .\nbroken\n')
    df = read_rdf(spark, str(tmp_path / "a.nt"), lenient=True)
    assert df.count() == 2 and read_bad_lines(spark, str(tmp_path / "a.nt")).count() == 1
    assert df.where("o.lang = 'en'").first()["o"]["v"] == "v\n1"
    (tmp_path / "b.ttl").write_text(PEOPLE)
    assert read_rdf(spark, str(tmp_path / "b.ttl")).count() == 16
    results.write_nquads(read_rdf(spark, str(tmp_path / "b.ttl")), str(tmp_path / "out"))
    assert read_rdf(spark, str(tmp_path / "out"), "application/n-quads").count() == 16
    pages = spark.createDataFrame([("http://h/", '<script type="text/turtle"><http://x/a> <http://x/b> 1 .</script>'), ("http://i/", None)], "url string, html string")
    assert read_column(pages, "html", base="url").count() == 1


def test_writers(spark):
    e = Engine(spark, from_text(spark, PEOPLE), prefixes={"": "http://x/", "foaf": "http://xmlns.com/foaf/0.1/"})
    b = e.bindings('SELECT ?s ?n WHERE { ?s a :Person OPTIONAL { ?s foaf:name ?n FILTER(LANG(?n) = "es") } } ORDER BY ?s')
    doc = json.loads(results.sparql_json_text(b))
    assert doc["results"]["bindings"][0]["n"] == {"type": "literal", "value": "Alicia", "xml:lang": "es"} and "n" not in doc["results"]["bindings"][1]
    assert '<literal xml:lang="es">Alicia</literal>' in results.sparql_xml_text(b)
    assert results.csv_text(b) == "s,n\r\nhttp://x/Alice,Alicia\r\nhttp://x/Bob,\r\n"
    assert results.tsv_text(b).splitlines()[1] == '<http://x/Alice>\t"Alicia"@es'
    assert json.loads(results.plain_json_text(b))[0]["n"] == '"Alicia"@es'
    assert results.sparql_json_text(True) == '{"head": {}, "boolean": true}' and "<boolean>false" in results.sparql_xml_text(False)
    assert "Alicia" in results.table_text(b) and "?n: Alicia" in results.simple_text(b) and results.stats_text(b).strip().endswith("COUNT,2")
    assert json.loads(results.tree_text(e.bindings("SELECT ?id ?friend_name WHERE { ?id foaf:knows/foaf:name ?friend_name }")))[0]["friend"][0]["name"] == ["Bob"]
    q = e.query("CONSTRUCT { ?s foaf:name ?n } WHERE { ?s foaf:name ?n }")
    for kind, write in results.QUAD_FORMATS.items():
        assert len(parse(write(q), kind)) == 4, kind
    assert "foaf:name" in results.turtle_text(q, {"foaf": "http://xmlns.com/foaf/0.1/"})


def test_lists_and_paths(spark):
    e = Engine(spark, from_text(spark, PEOPLE), prefixes={"": "http://x/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})
    assert sorted(r[0] for r in e.query("SELECT ?v WHERE { :Alice :list/rdf:rest*/rdf:first ?v }").collect()) == ["1", "2.5", "x"]
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    g = QuadSource(rows(spark, [(iri(f"http://x/{a}"), "http://x/p", iri(f"http://x/{b}"), "") for a, b in edges]))
    e = Engine(spark, g, prefixes={"": "http://x/"})
    assert e.query("SELECT * WHERE { ?s :p+ ?o }").count() == 12
    assert e.query("SELECT * WHERE { ?s :p* ?o }").count() == 13
    assert sorted(r[0][-1] for r in e.query("SELECT ?o WHERE { :a :p+ ?o }").collect()) == list("abcd")
    assert e.query("SELECT ?s WHERE { ?s :p+ ?s }").count() == 3
    assert e.query("ASK { :d :p+ :a }") is False and e.query("ASK { :a :p* :d }") is True
    assert e.query("SELECT ?o WHERE { :nowhere :p* ?o }").count() == 1
    assert e.query("SELECT * WHERE { :c (:p|^:p) ?o }").count() == 3
    assert e.query("SELECT * WHERE { :c !(:q|^:r) ?o }").count() == 3
    assert e.query("SELECT * WHERE { :a (:p/:p)? ?o }").count() == 2


def test_paths_stay_in_their_graph(spark):
    q = [("a", "b", "g"), ("b", "c", "h"), ("b", "d", "g")]
    e = Engine(spark, QuadSource(rows(spark, [(iri(f"http://x/{a}"), "http://x/p", iri(f"http://x/{b}"), f"http://x/{g}") for a, b, g in q])), prefixes={"": "http://x/"})
    got = {(r.g[-1], r.o[-1]) for r in e.query("SELECT ?g ?o WHERE { GRAPH ?g { :a :p+ ?o } }").collect()}
    assert got == {("g", "b"), ("g", "d")}


def test_updates(spark):
    store = Store(spark)
    e = Engine(spark, store, prefixes={"": "http://x/"}, load=lambda s: from_text(spark, PEOPLE))
    names = lambda: sorted(r[0] for r in e.query("SELECT ?o WHERE { { :a :p ?o } UNION { GRAPH ?g { :a :p ?o } } }").collect())
    e.update("INSERT DATA { :a :p 1, 1, 2 . GRAPH :g { :a :p 3 } }")
    assert names() == ["1", "2", "3"]
    e.update("DELETE DATA { :a :p 1 } ; INSERT { ?s :q ?o . [] :r ?o } WHERE { ?s :p ?o }")
    assert names() == ["2", "3"] and e.query("SELECT * WHERE { ?s :r ?o }").count() == 1
    e.update("WITH :g DELETE { ?s :p ?o } INSERT { ?s :p 4 } WHERE { ?s :p ?o }")
    assert names() == ["2", "4"]
    e.update("COPY :g TO :h ; MOVE :h TO :i ; ADD :g TO DEFAULT")
    assert names() == ["2", "4", "4", "4"] and store.named() == {"http://x/g", "http://x/i"}
    with pytest.raises(KeyError):
        e.update("CREATE GRAPH :g")
    with pytest.raises(KeyError):
        e.update("CLEAR GRAPH :none")
    e.update("CREATE SILENT GRAPH :g ; CLEAR SILENT GRAPH :none ; CREATE GRAPH :new ; CLEAR GRAPH :g")
    assert {"http://x/new", "http://x/g"} <= store.named()
    e.update("DROP NAMED ; LOAD <doc> INTO GRAPH :l")
    assert store.named() == {"http://x/l"} and store.quads.where("g = 'http://x/l'").count() == 16
    e.update("DROP ALL")
    assert store.quads.count() == 0
    with pytest.raises(PermissionError):
        Engine(spark, Store(spark, read_only=True)).update("DROP ALL")
    twice = from_text(spark, "<http://x/a> <http://x/p> 1 .")
    e = Engine(spark, Store(spark, twice.union(twice)), prefixes={"": "http://x/"})
    e.update(" ; ".join(f"INSERT DATA {{ :a :p {i} }}" for i in (1, 2, 2, 3)) + " ; DELETE DATA { :a :p 3 } ; INSERT DATA { :a :p 3 }")
    assert e.query("SELECT * WHERE { :a :p ?o }").count() == 3


def test_datasets(spark):
    q = [(iri("http://x/s"), "http://x/p", literal(v), g) for v, g in (("0", ""), ("1", "http://x/g"), ("2", "http://x/h"), ("1", "http://x/h"))]
    plain, all_ = Engine(spark, QuadSource(rows(spark, q)), prefixes={"": "http://x/"}), Engine(spark, QuadSource(rows(spark, q), union_default=True), prefixes={"": "http://x/"})
    vals = lambda e, t: sorted(r[0] for r in e.query(t).collect())
    assert vals(plain, "SELECT ?o WHERE { :s :p ?o }") == ["0"] and vals(all_, "SELECT ?o WHERE { :s :p ?o }") == ["0", "1", "2"]
    assert vals(plain, "SELECT ?o FROM :g FROM :h WHERE { :s :p ?o }") == ["1", "2"]
    assert vals(plain, "SELECT ?o FROM NAMED :h WHERE { GRAPH ?g { :s :p ?o } }") == ["1", "2"] and vals(plain, "SELECT ?o FROM NAMED :h WHERE { :s :p ?o }") == []
    assert vals(plain, "SELECT ?o FROM NAMED :h WHERE { GRAPH :g { :s :p ?o } }") == []


def test_aggregates_with_errors(spark):
    doc = '@prefix : <http://x/> . :a :v 1, 2.5 . :b :v 1, "x" . :c :w 3 . :d :v "1"^^<http://x/t> .'
    e = Engine(spark, from_text(spark, doc), prefixes={"": "http://x/"})
    got = {r[0][-1]: r[1] for r in e.query("SELECT ?s (SUM(?v) AS ?t) WHERE { ?s :v ?v } GROUP BY ?s").collect()}
    assert got == {"a": "3.5", "b": None, "d": None}
    got = {r[0][-1]: r[1:] for r in e.query("SELECT ?s (COUNT(?v) AS ?n) (MAX(?v + 1) AS ?m) (AVG(?v) AS ?a) WHERE { ?s ?p ?v } GROUP BY ?s").collect()}
    assert got["a"] == (2, "3.5", "1.75") and got["b"] == (2, None, None) and got["c"] == (1, "4", "3")
    r = e.query("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?s) (AVG(?v) AS ?a) (MIN(?v) AS ?m) (GROUP_CONCAT(?v) AS ?g) WHERE { ?s :none ?v }").first()
    assert (r.n, float(r.s), float(r.a), r.m, r.g) == (0, 0, 0, None, "")


def test_order_of_unlike_terms(spark):
    doc = '@prefix : <http://x/> . :s :v 2, 10, 1.5, "b", "a", :i, true, _:n, "x"@en .'
    e = Engine(spark, from_text(spark, doc), prefixes={"": "http://x/"})
    got = [r[0] for r in e.query("SELECT ?v WHERE { :s :v ?v } ORDER BY ?v").collect()]
    assert got[1:] == ["http://x/i", "1.5", "2", "10", "a", "b", "true", "x"]
    got = [r[0] for r in e.query("SELECT ?v ?w WHERE { :s :v ?v OPTIONAL { FILTER(isIRI(?v)) BIND(1 AS ?w) } } ORDER BY DESC(?w) DESC(?v) LIMIT 1").collect()]
    assert got == ["x"] or got == ["http://x/i"]


def test_triple_terms(spark):
    doc = '@prefix : <http://x/> . :r <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( :a :b "c" )>> ; :sure 0.9 .'
    e = Engine(spark, from_text(spark, doc), prefixes={"": "http://x/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})
    assert e.query("SELECT ?o ?p WHERE { ?r rdf:reifies <<( :a :b ?o )>> ; :sure ?p }").collect() == [("c", "0.9")]


def test_initial_bindings_and_services(spark, small):
    e = Engine.over_tables(spark, small)
    assert e.query("SELECT ?n WHERE { ?x nation:n_name ?n ; nation:n_nationkey ?k }", {"k": literal("3", "http://www.w3.org/2001/XMLSchema#integer")}).collect() == [("NATION_3",)]
    with pytest.raises(ValueError):
        e.query("SELECT * WHERE { SERVICE <http://none/> { ?s ?p ?o } }")
    assert e.query("SELECT * WHERE { ?x region:r_name 'ASIA' SERVICE SILENT <http://none/> { ?s ?p ?o } }").count() == 1


def test_parse_errors():
    for bad in ("SELECT ?x", "SELECT ?x WHERE { ?x ?y }", "SELECT ?x WHERE { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT ?x (SUM(?y) AS ?s) WHERE { ?x ?p ?y }", "SELECT * WHERE { ?s un:known ?o }", "ASK { FILTER(COUNT(?x) > 1) } x"):
        with pytest.raises(ParseError):
            parse_query(bad)


ROUND_TRIP = [
    "PREFIX : <http://x/> SELECT DISTINCT ?s (COUNT(*) AS ?n) WHERE { ?s :p ?o OPTIONAL { ?s :q ?z FILTER(?z > 1) } MINUS { ?s :r 2 } } GROUP BY ?s HAVING(COUNT(*) > 1) ORDER BY DESC(?n) LIMIT 3 OFFSET 1",
    "PREFIX : <http://x/> SELECT ?s WHERE { { ?s :p/:q* ?o } UNION { ?s ^:r|!(:t) ?o } VALUES (?s) { (:a) (UNDEF) } FILTER NOT EXISTS { ?s :z ?o } BIND(IF(?o IN (1, 2), 'a', 'b') AS ?w) }",
    "PREFIX : <http://x/> ASK { GRAPH ?g { ?s :p 'x'@en } SERVICE SILENT :s { ?s :q ?o } }",
]


@pytest.mark.parametrize("text", ROUND_TRIP)
def test_serialized_query_is_read_again(text):
    q = parse_query(text)
    again = parse_query(to_sparql(q))
    assert again.kind == q.kind and again.vars == q.vars and in_scope(again.plan) == in_scope(q.plan)


def test_serialized_query_gives_the_same_rows(spark, small):
    from quadspark.queries import SPARQL

    e = Engine.over_tables(spark, small)
    for name in ("optional_expr", "group_having", "values_undef", "subquery_limit", "exists_in_or", "path_alt"):
        text = SPARQL[name][0]
        again = e.explain(text, "sparql")
        assert sorted(map(str, e.query(text).collect())) == sorted(map(str, e.query(again).collect())), name


def test_explain(spark, small):
    e = Engine.over_tables(spark, small)
    text = "SELECT ?n WHERE { ?c customer:c_name ?n ; customer:c_mktsegment 'BUILDING' }"
    assert "bgp" in e.explain(text, "logical") and "Pattern" in e.explain(text, "parsed")
    plan = e.explain(text)
    assert plan.count("Scan parquet") <= 2 and "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_name:string,c_mktsegment:string>" in plan
    assert "Join" not in plan and "Exchange" not in plan  # a star is one scan


def test_foreign_keys_join_as_numbers(spark, small):
    plan = Engine.over_tables(spark, small).explain("SELECT ?n WHERE { ?o orders:custRef ?c ; orders:o_orderstatus 'F' . ?c customer:c_name ?n }")
    assert "concat" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_graphql(spark, small):
    context = {"name": "http://tpch/nation#n_name", "region": "http://tpch/nation#regionRef", "label": "http://tpch/region#r_name", "customers": {"@reverse": "http://tpch/customer#nationRef"}, "called": "http://tpch/customer#c_name"}
    e = Engine.over_tables(spark, small)
    e.parse = lambda q: parse_graphql(q, context)
    df = e.query('{ name(_: "NATION_3") id region { label } }')
    assert df.columns == ["id", "region_label"] and df.collect() == [("http://tpch/nation/3", e.query('{ region { label } name(_: "NATION_3") }').first()[0])]
    assert e.query('{ name customers @optional { called } }').count() >= 150
    assert e.query("query Q { name(first: 4) }").count() == 4


def test_stream(spark, small, tmp_path):
    from quadspark.streaming.standing import start, stream_query

    src = spark.read.parquet(f"{small}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    load = lambda t: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")) if t == "events" else spark.read.parquet(f"{small}/{t}.parquet")
    prefixes = {"events": "http://tpch/events#"}
    df = stream_query(spark, "SELECT ?k ?v WHERE { ?e events:event_id ?k ; events:value ?v ; events:event_type 'click' FILTER(?v > 10) }", load, prefixes=prefixes)
    assert df.isStreaming
    start(df, "clicks").awaitTermination()
    assert spark.table("clicks").count() == src.where("event_type = 'click' AND value > 10").count()
    df = stream_query(spark, "SELECT ?t (COUNT(*) AS ?n) WHERE { ?e events:event_type ?t } GROUP BY ?t", load, prefixes=prefixes)
    start(df, "kinds", complete=True).awaitTermination()
    assert {tuple(r) for r in spark.table("kinds").collect()} == {(r[0], r[1]) for r in src.groupBy("event_type").count().collect()}
    with pytest.raises(ValueError):
        stream_query(spark, "SELECT ?t WHERE { ?e events:event_type ?t } ORDER BY ?t", load, prefixes=prefixes)


def test_cli(spark, tmp_path, capsys):
    from quadspark.cli import main

    (tmp_path / "p.ttl").write_text(PEOPLE)
    assert main([str(tmp_path / "p.ttl"), "-q", "SELECT ?o WHERE { <http://x/Alice> <http://x/age> ?o }", "-t", "text/csv"], spark) == 0
    assert capsys.readouterr().out == "o\r\n30\r\n"
    assert main([str(tmp_path / "p.ttl"), "-q", "ASK { ?s ?p 30 }", "-t", "application/sparql-results+json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["boolean"] is True


def test_quads_of_tables(spark, small):
    t = TableSource(lambda n: spark.read.parquet(f"{small}/{n}.parquet"))
    q = t.quads(["region", "nation"])
    assert q.count() == 5 * 3 + 25 * 5
    e = Engine(spark, QuadSource(q, union_default=True), prefixes={"n": "http://tpch/nation#", "r": "http://tpch/region#"})
    assert e.query("SELECT ?a ?b WHERE { ?x n:n_name ?a ; n:regionRef/r:r_name ?b }").count() == 25
    assert q.where(F.col("o.k") == 1).count() == 5 + 50


def test_endpoint(spark, small):
    import threading
    from urllib.error import HTTPError
    from urllib.parse import quote
    from urllib.request import Request, urlopen

    from quadspark.server import choose, serve

    s = serve(Engine.over_tables(spark, small), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}/sparql"
    q = "SELECT ?n WHERE { ?x region:r_name ?n FILTER(?n = 'ASIA') }"
    with urlopen(Request(f"{at}?query={quote(q)}", headers={"Accept": "text/csv"})) as r:
        assert r.read() == b"n\r\nASIA\r\n"
    with urlopen(Request(at, data=q.encode(), headers={"Content-Type": "application/sparql-query"})) as r:
        assert json.loads(r.read())["results"]["bindings"] == [{"n": {"type": "literal", "value": "ASIA"}}]
    for bad, code in ((f"{at}?query=nonsense", 400), (at, 400), (at.replace("sparql", "other"), 404)):
        with pytest.raises(HTTPError) as e:
            urlopen(bad)
        assert e.value.code == code
    with pytest.raises(HTTPError) as e:
        urlopen(Request(at, data=b"DROP ALL", headers={"Content-Type": "application/sparql-update"}))
    assert e.value.code == 403
    s.shutdown()
    assert choose("text/csv;q=0.5, application/json", ["text/csv", "application/json"]) == "application/json" and choose("image/png", ["text/csv"]) is None


def test_optional_with_exists(spark, small):
    e = Engine.over_tables(spark, small)
    got = e.query("SELECT ?k ?q WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:quality ?q FILTER EXISTS { ?d documents:lang 'en' } } }")
    want = e.query("SELECT ?k ?q WHERE { ?d documents:doc_id ?k ; documents:lang ?g OPTIONAL { ?l labels:docRef ?d ; labels:quality ?q FILTER(?g = 'en') } }")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_iri_constants_reach_the_scan(spark, small):
    e = Engine.over_tables(spark, small)
    text = "SELECT ?n WHERE { ?c customer:c_name ?n FILTER(?c = <http://tpch/customer/7>) }"
    assert "EqualTo(c_custkey,7)" in e.explain(text) and e.query(text).count() == 1
    assert e.query(text.replace("/7>", "/07>")).count() == 0 and e.query(text.replace("customer/7>", "part/7>")).count() == 0


def test_options(spark, small, tmp_path):
    ex = {"prefixes": {"ex": "http://ex/"}}
    assert Engine(spark, extension_creator=lambda n: F.upper if n.endswith("up") else None, **ex).query("SELECT (ex:up('a') AS ?x) {}").first()[0] == "A"
    ask = "ASK { FILTER('b'^^ex:t > 'a'^^ex:t) }"
    assert Engine(spark, **ex).query(ask) is False and Engine(spark, non_lexical_comparison=True, **ex).query(ask) is True
    assert Engine(spark, full_term_comparison=True, **ex).query("ASK { FILTER(ex:b > ex:a) }") is True
    plus = Engine.over_tables(spark, small, opt_plus=True).query("SELECT ?n ?c WHERE { ?x nation:n_name ?n OPTIONAL { ?y customer:nationRef ?x ; customer:c_custkey ?c } }")
    assert plus.count() == 25 + spark.read.parquet(f"{small}/customer.parquet").count()
    (tmp_path / "a.ttl").write_text("<http://x/a> <http://x/p> 1 .")
    (tmp_path / "b.ttl").write_text("this is broken")
    both = [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")]
    assert read_rdf(spark, both, lenient=True, attribute=True).select("source").first()[0] == both[0]
    with pytest.raises(Exception, match="expected"):
        read_rdf(spark, both).count()
    assert Engine(spark, read_rdf(spark, both, lenient=True)).query("ASK { ?s ?p 1 }") is True


def test_store_by_predicate(spark, small, tmp_path):
    from quadspark.sources.quads import read_by_predicate, write_by_predicate

    q = TableSource(lambda n: spark.read.parquet(f"{small}/{n}.parquet")).quads(["nation"], named=False)
    write_by_predicate(q, str(tmp_path / "q"))
    back = read_by_predicate(spark, str(tmp_path / "q"))
    assert back.exceptAll(q).count() == q.exceptAll(back).count() == 0
    e = Engine(spark, back, prefixes={"n": "http://tpch/nation#"})
    plan = e.explain("SELECT ?x WHERE { ?x n:n_name 'NATION_3' }")
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o.v,NATION_3)" in plan
    assert e.query("SELECT ?x WHERE { ?x n:n_name 'NATION_3' }").collect() == [("http://tpch/nation/3",)]


def test_shapes_in_compact_syntax(spark):
    doc = """PREFIX ex: <http://ex/>
    shape ex:PersonShape -> ex:Person { closed=true ignoredProperties=[rdf:type] . ex:ssn xsd:string [0..1] pattern="^\\\\d{3}$" . ^ex:worksFor|ex:paid IRI @ex:CompanyShape ex:Company|ex:Firm [1..*] . ex:address BlankNode { ex:city xsd:string [1..1] . } . ex:n !xsd:integer . }
    shapeClass ex:CompanyShape { ex:name [1..1] in=["a" "b"@en 3] . }"""
    got = n3(parse(doc, "text/shaclc"))
    sh = "http://www.w3.org/ns/shacl#"
    assert ("<http://ex/PersonShape>", sh + "targetClass", "<http://ex/Person>", "") in got and ("<http://ex/CompanyShape>", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "<http://www.w3.org/2000/01/rdf-schema#Class>", "") in got
    assert {p for _, p, _, _ in got} >= {sh + p for p in ("property", "path", "minCount", "maxCount", "datatype", "or", "not", "node", "inversePath", "alternativePath", "closed", "ignoredProperties", "pattern", "nodeKind", "in", "class")}
    again = n3(parse(results.shaclc_text(from_text(spark, doc, "text/shaclc"), {"ex": "http://ex/"}), "text/shaclc"))
    count = lambda q: sorted((p, o if not o.startswith("_:") else "") for _, p, o, _ in q)
    assert count(again) == count(got)
    with pytest.raises(ParseError):
        parse("shape <http://x/s> { nonsense=1 . }", "text/shaclc")
