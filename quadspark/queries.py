"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from threading import Thread
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.engine import Engine
from quadspark.operators.scratch import shared_dir
from quadspark.operators.update import Store
from quadspark.plans.graphql import parse_graphql
from quadspark.server import serve
from quadspark.sources.quads import QuadSource
from quadspark.sources.rdf_files import from_text, read_column, read_rdf
from quadspark.sources.results import csv_lines, jsonld_text, nquads_lines, sparql_json_text, sparql_xml_text, table_text, tree_text, tsv_lines, turtle_text, write_jsonld, write_nquads, write_turtle
from quadspark.sources.virtual import TableSource
from quadspark.terms import IRI, literal, n3_col, term_col

#: name -> (SPARQL over the tables as a virtual graph, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "flagship": (
        "SELECT ?seg (COUNT(?o) AS ?n) (ROUND(SUM(?price)) AS ?total) WHERE { ?o orders:custRef ?c ; orders:o_totalprice ?price . ?c customer:c_mktsegment ?seg . FILTER(?price > 100000) } GROUP BY ?seg ORDER BY DESC(?total)",
        "SELECT c_mktsegment AS seg, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "bgp_star": (
        "SELECT ?k ?name ?bal WHERE { ?c customer:c_custkey ?k ; customer:c_name ?name ; customer:c_acctbal ?bal ; customer:c_mktsegment 'BUILDING' }",
        "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "bgp_chain": (
        "SELECT ?k ?region WHERE { ?o orders:o_orderkey ?k ; orders:custRef ?c . ?c customer:nationRef ?n . ?n nation:regionRef ?r . ?r region:r_name ?region }",
        "SELECT o_orderkey AS k, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_cycle": (
        "SELECT ?lk ?sk ?ck WHERE { ?l lineitem:orderRef ?o ; lineitem:suppRef ?s ; lineitem:l_orderkey ?lk . ?o orders:custRef ?c . ?s supplier:nationRef ?n ; supplier:s_suppkey ?sk . ?c customer:nationRef ?n ; customer:c_custkey ?ck }",
        "SELECT l_orderkey AS lk, s_suppkey AS sk, c_custkey AS ck FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey",
    ),
    "bgp_var_predicate": (
        "SELECT ?p ?o WHERE { <http://tpch/nation/3> ?p ?o }",
        "SELECT 'http://tpch/nation#n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://tpch/nation#n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://tpch/nation#n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://tpch/nation#regionRef', 'http://tpch/region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://tpch/nation'",
    ),
    "bgp_constant_subject": ("SELECT ?name WHERE { <http://tpch/customer/7> customer:c_name ?name }", "SELECT c_name AS name FROM customer WHERE c_custkey = 7"),
    "repeated_variable": ("SELECT ?k WHERE { ?s supplier:s_suppkey ?k ; supplier:s_nationkey ?k }", "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey = s_nationkey"),
    "filter_numeric": ("SELECT ?k ?p WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p FILTER(?p >= 1000 && ?p * 2 < 300000.5) }", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice >= 1000 AND o_totalprice * 2 < 300000.5"),
    "filter_3vl_or": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } FILTER(?t = 1 || ?k < 100) }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 OR d.doc_id < 100",
    ),
    "filter_in": ("SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderstatus ?s FILTER(?s IN ('F', 'P')) }", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "filter_not_in": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_size ?z FILTER(?z NOT IN (1, 2, 3)) }", "SELECT p_partkey AS k FROM part WHERE p_size NOT IN (1, 2, 3)"),
    "filter_date": (
        "SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d FILTER(?d >= '1996-03-01T00:00:00'^^xsd:dateTime && ?d < '1996-04-01T00:00:00Z'^^xsd:dateTime) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'",
    ),
    "same_term": ("SELECT ?a ?b WHERE { ?x supplier:s_suppkey ?a ; supplier:nationRef ?n . ?y supplier:s_suppkey ?b ; supplier:nationRef ?m FILTER(sameTerm(?n, ?m) && ?a < ?b) }", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey"),
    "bind_arith": (
        "SELECT ?k ?v WHERE { ?l lineitem:l_orderkey ?k ; lineitem:l_extendedprice ?e ; lineitem:l_discount ?d ; lineitem:l_tax ?t BIND(?e * (1 - ?d) * (1 + ?t) AS ?v) FILTER(?v > 50000) }",
        "SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS v FROM lineitem WHERE l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000",
    ),
    "bind_if": ("SELECT ?k ?size WHERE { ?p part:p_partkey ?k ; part:p_size ?z BIND(IF(?z > 25, 'large', 'small') AS ?size) }", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part"),
    "division": ("SELECT ?k (xsd:double(?z / 3) AS ?third) WHERE { ?p part:p_partkey ?k ; part:p_size ?z FILTER(?z = 3 || ?z = 6) }", "SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 3 AS third FROM part WHERE p_size IN (3, 6)"),
    "coalesce_optional": (
        "SELECT ?k ?q WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:quality ?x } BIND(COALESCE(?x, -1) AS ?q) }",
        "SELECT d.doc_id AS k, CAST(coalesce(l.quality, -1) AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "optional": (
        "SELECT ?k ?toxic WHERE { ?d documents:doc_id ?k ; documents:lang 'en' OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?toxic } }",
        "SELECT d.doc_id AS k, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en'",
    ),
    "optional_expr": (
        "SELECT ?k ?p WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b OPTIONAL { ?o orders:custRef ?c ; orders:o_totalprice ?p FILTER(?p > 200000 && ?b > 5000) } }",
        "SELECT c_custkey AS k, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 5000",
    ),
    "optional_nested": (
        "SELECT ?name ?sk ?bal WHERE { ?n nation:n_name ?name OPTIONAL { ?s supplier:nationRef ?n ; supplier:s_suppkey ?sk OPTIONAL { ?s supplier:s_acctbal ?bal FILTER(?bal > 5000) } } }",
        "SELECT n_name AS name, s.s_suppkey AS sk, t.s_acctbal AS bal FROM nation LEFT JOIN supplier s ON s.s_nationkey = n_nationkey LEFT JOIN supplier t ON t.s_suppkey = s.s_suppkey AND t.s_acctbal > 5000",
    ),
    "optional_then_join": (
        "SELECT ?a ?b ?q WHERE { ?d documents:doc_id ?a OPTIONAL { ?l labels:docRef ?d ; labels:quality ?q ; labels:toxic 1 } ?m labels:doc_id ?b ; labels:docRef ?d ; labels:quality ?q }",
        "SELECT d.doc_id AS a, m.doc_id AS b, CAST(m.quality AS BIGINT) AS q FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id JOIN labels m ON m.doc_id = d.doc_id AND (l.quality IS NULL OR l.quality = m.quality)",
    ),
    "union_same": ("SELECT ?name WHERE { { ?x nation:n_name ?name } UNION { ?x region:r_name ?name } }", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "union_partial": ("SELECT ?n ?r WHERE { { ?x nation:n_name ?n } UNION { ?x region:r_name ?r } }", "SELECT n_name AS n, NULL::VARCHAR AS r FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    "minus": (
        "SELECT ?k WHERE { ?c customer:c_custkey ?k MINUS { ?o orders:custRef ?c ; orders:o_orderstatus 'F' ; orders:o_totalprice ?p FILTER(?p > 100000) } }",
        "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)",
    ),
    "minus_disjoint": ("SELECT ?k WHERE { ?c customer:c_custkey ?k MINUS { ?x region:r_name ?name } }", "SELECT c_custkey AS k FROM customer"),
    "exists": (
        "SELECT ?k WHERE { ?c customer:c_custkey ?k FILTER EXISTS { ?o orders:custRef ?c ; orders:o_orderpriority '1-URGENT' } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "not_exists": (
        "SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b FILTER NOT EXISTS { ?o orders:custRef ?c ; orders:o_totalprice ?p FILTER(?p > ?b * 40) } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)",
    ),
    "exists_in_or": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k FILTER(?k < 50 || EXISTS { ?l labels:docRef ?d ; labels:toxic 1 }) }",
        "SELECT doc_id AS k FROM documents d WHERE doc_id < 50 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    ),
    "exists_correlated_or": (
        "SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?bal FILTER(?k < 0 || EXISTS { ?o orders:custRef ?c ; orders:o_totalprice ?p FILTER(?p > ?bal * 30) }) }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)",
    ),
    "exists_bind": (
        "SELECT ?k ?e WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?bal BIND(EXISTS { ?o orders:custRef ?c ; orders:o_totalprice ?p FILTER(?p > ?bal * 30) } AS ?e) }",
        "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) AS e FROM customer",
    ),
    "exists_in_union": (
        "SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?bal ; customer:nationRef ?n FILTER EXISTS { { ?o orders:custRef ?c ; orders:o_totalprice ?p FILTER(?p > ?bal * 60) } UNION { ?s supplier:nationRef ?n ; supplier:s_acctbal ?b FILTER(?b < ?bal / 100) } } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal / 100)",
    ),
    "exists_unbound_key": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } FILTER(EXISTS { ?m labels:toxic ?t ; labels:quality 0 } || ?k < 0) }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE EXISTS (SELECT 1 FROM labels m WHERE m.quality = 0 AND (l.toxic IS NULL OR m.toxic = l.toxic))",
    ),
    "not_exists_nested": (
        "SELECT ?name WHERE { ?n nation:n_name ?name FILTER NOT EXISTS { ?s supplier:nationRef ?n ; supplier:s_acctbal ?b FILTER NOT EXISTS { ?c customer:nationRef ?n ; customer:c_acctbal ?d FILTER(?d > ?b + 1000) } } }",
        "SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > s_acctbal + 1000))",
    ),
    "exists_optional_inside": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k ; documents:lang ?g FILTER(EXISTS { ?l labels:docRef ?d ; labels:toxic ?t OPTIONAL { ?l labels:quality ?q FILTER(?k < 200) } FILTER(?t = 0 || BOUND(?q)) } && ?g = 'en') }",
        "SELECT d.doc_id AS k FROM documents d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic IS NOT NULL AND (l.toxic = 0 OR (d.doc_id < 200 AND l.quality IS NOT NULL)))",
    ),
    "optional_optional": (
        "SELECT ?k ?t ?b WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t ; labels:quality 1 } OPTIONAL { ?r region:r_regionkey ?t ; region:r_name ?b } }",
        "SELECT d.doc_id AS k, CAST(coalesce(l.toxic, r_regionkey) AS BIGINT) AS t, r_name AS b FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id LEFT JOIN region ON l.toxic IS NULL OR l.toxic = r_regionkey",
    ),
    "minus_two_unbound": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } OPTIONAL { ?m labels:docRef ?d ; labels:quality ?q } MINUS { VALUES (?t ?q) { (0 UNDEF) (UNDEF 0) (1 1) } } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (coalesce(l.toxic = 0, false) OR coalesce(l.quality = 0, false) OR (l.toxic IS NOT NULL OR l.quality IS NOT NULL) AND coalesce(l.toxic = 1, true) AND coalesce(l.quality = 1, true))",
    ),
    "embeddings": ("SELECT ?k ?l WHERE { ?e embeddings:vec_id ?k ; embeddings:label ?l FILTER(?l > 2) }", "SELECT vec_id AS k, CAST(label AS BIGINT) AS l FROM embeddings WHERE label > 2"),
    "values": ("SELECT ?k ?name WHERE { VALUES ?name { 'EUROPE' 'ASIA' } ?r region:r_name ?name ; region:r_regionkey ?k }", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region WHERE r_name IN ('EUROPE', 'ASIA')"),
    "values_undef": (
        "SELECT ?k ?name WHERE { ?r region:r_regionkey ?k ; region:r_name ?name VALUES (?k ?name) { (1 UNDEF) (UNDEF 'ASIA') (3 'ASIA') } }",
        "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region JOIN (VALUES (1, NULL), (NULL, 'ASIA'), (3, 'ASIA')) v(a, b) ON (a IS NULL OR a = r_regionkey) AND (b IS NULL OR b = r_name)",
    ),
    "subquery_limit": (
        "SELECT ?k ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o orders:custRef ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 10 } ?c customer:c_custkey ?k }",
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, ('http://tpch/customer/' || o_custkey) LIMIT 10",
    ),
    "distinct": ("SELECT DISTINCT ?s ?p WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "distinct_count": ("SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o orders:custRef ?c }", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "reduced": ("SELECT REDUCED ?name WHERE { ?r region:r_name ?name }", "SELECT r_name AS name FROM region"),
    "order_limit": ("SELECT ?k ?p WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20"),
    "order_offset": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_brand ?b } ORDER BY ?b DESC(?k) OFFSET 15 LIMIT 10", "SELECT p_partkey AS k FROM part ORDER BY p_brand, k DESC LIMIT 10 OFFSET 15"),
    "group_count": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?e events:event_type ?t } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1"),
    "group_sum_avg": (
        "SELECT ?f (ROUND(SUM(?q)) AS ?total) (ROUND(AVG(?p) * 100) / 100 AS ?mean) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q ; lineitem:l_extendedprice ?p } GROUP BY ?f",
        "SELECT l_returnflag AS f, floor(sum(l_quantity) + 0.5) AS total, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS mean FROM lineitem GROUP BY 1",
    ),
    "group_min_max": ("SELECT ?b (MIN(?z) AS ?lo) (MAX(?p) AS ?hi) (MIN(?n) AS ?first) WHERE { ?x part:p_brand ?b ; part:p_size ?z ; part:p_retailprice ?p ; part:p_name ?n } GROUP BY ?b", "SELECT p_brand AS b, CAST(min(p_size) AS BIGINT) AS lo, max(p_retailprice) AS hi, min(p_name) AS first FROM part GROUP BY 1"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?name; SEPARATOR=', ') AS ?names) WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?name } GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "group_sample": ("SELECT ?s (SAMPLE(?o) AS ?one) WHERE { ?x orders:o_orderstatus ?s . BIND('x' AS ?o) } GROUP BY ?s", "SELECT o_orderstatus AS s, 'x' AS one FROM orders GROUP BY 1"),
    "group_having": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o orders:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "group_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_empty": ("SELECT (COUNT(?x) AS ?n) (SUM(?k) AS ?s) WHERE { ?x region:r_regionkey ?k FILTER(?k > 99) }", "SELECT 0::BIGINT AS n, 0::BIGINT AS s"),
    "count_star_distinct": ("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderpriority ?p FILTER(BOUND(?o) && ?s = 'F') }", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "sum_distinct": ("SELECT (SUM(DISTINCT ?z) AS ?n) (COUNT(DISTINCT ?z) AS ?m) WHERE { ?p part:p_size ?z }", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS n, count(DISTINCT p_size) AS m FROM part"),
    "str_funcs": (
        "SELECT ?k (UCASE(?n) AS ?u) (LCASE(?b) AS ?l) (CONCAT(?b, '/', STR(?k)) AS ?c) WHERE { ?p part:p_partkey ?k ; part:p_name ?n ; part:p_brand ?b }",
        "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, p_brand || '/' || p_partkey AS c FROM part",
    ),
    "regex": ("SELECT ?k WHERE { ?p part:p_partkey ?k ; part:p_type ?t FILTER REGEX(?t, '^st.*el$', 'i') }", "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_type, '(?i)^st.*el$')"),
    "replace": ("SELECT ?k (REPLACE(?n, '[0-9]+', '<$0>') AS ?r) WHERE { ?s supplier:s_suppkey ?k ; supplier:s_name ?n }", r"SELECT s_suppkey AS k, regexp_replace(s_name, '([0-9]+)', '<\1>', 'g') AS r FROM supplier"),
    "substr_strlen": ("SELECT ?k (SUBSTR(?n, 3) AS ?a) (SUBSTR(?n, 0, 4) AS ?b) (STRLEN(?n) AS ?len) WHERE { ?c customer:c_custkey ?k ; customer:c_name ?n }", "SELECT c_custkey AS k, substr(c_name, 3) AS a, substr(c_name, 1, 3) AS b, length(c_name) AS len FROM customer"),
    "strbefore_after": (
        "SELECT ?k (STRBEFORE(?p, '-') AS ?a) (STRAFTER(?p, '-') AS ?b) (STRAFTER(?p, '@@') AS ?c) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderpriority ?p }",
        "SELECT o_orderkey AS k, CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, 1, instr(o_orderpriority, '-') - 1) ELSE '' END AS a, CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS b, '' AS c FROM orders",
    ),
    "contains_starts_ends": ("SELECT ?k WHERE { ?n nation:n_nationkey ?k ; nation:n_name ?x FILTER(CONTAINS(?x, 'TION') && STRSTARTS(?x, 'NA') && !STRENDS(?x, '3')) }", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE contains(n_name, 'TION') AND starts_with(n_name, 'NA') AND NOT ends_with(n_name, '3')"),
    "date_parts": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }",
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h FROM orders",
    ),
    "hash_funcs": ("SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) WHERE { ?x supplier:s_suppkey ?k ; supplier:s_name ?n }", "SELECT s_suppkey AS k, md5(s_name) AS m, sha1(s_name) AS s, sha256(s_name) AS t FROM supplier"),
    "math_round": ("SELECT ?k (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ABS(?b) AS ?a) WHERE { ?s supplier:s_suppkey ?k ; supplier:s_acctbal ?b }", "SELECT s_suppkey AS k, floor(s_acctbal + 0.5) AS r, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, abs(s_acctbal) AS a FROM supplier"),
    "casts": (
        "SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:boolean(?z) AS ?t) (xsd:double(?z) AS ?d) WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b ; customer:c_nationkey ?z }",
        "SELECT c_custkey AS k, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_custkey AS VARCHAR) AS s, c_nationkey <> 0 AS t, CAST(c_nationkey AS DOUBLE) AS d FROM customer",
    ),
    "term_tests": (
        "SELECT ?k (isIRI(?c) AS ?a) (isLITERAL(?k) AS ?b) (isNUMERIC(?s) AS ?c1) (STR(DATATYPE(?k)) AS ?dt) WHERE { ?o orders:o_orderkey ?k ; orders:custRef ?c ; orders:o_orderstatus ?s }",
        "SELECT o_orderkey AS k, true AS a, true AS b, false AS c1, 'http://www.w3.org/2001/XMLSchema#integer' AS dt FROM orders",
    ),
    "encode_for_uri": ("SELECT ?k (ENCODE_FOR_URI(?n) AS ?e) WHERE { ?p part:p_partkey ?k ; part:p_name ?n }", "SELECT p_partkey AS k, url_encode(p_name) AS e FROM part"),
    "iri_function": ("SELECT ?k (IRI(CONCAT('http://x/', ?n)) AS ?i) WHERE { ?r region:r_regionkey ?k ; region:r_name ?n }", "SELECT CAST(r_regionkey AS BIGINT) AS k, 'http://x/' || r_name AS i FROM region"),
    "strlang_lang": ("SELECT ?k (LANG(STRLANG(?t, ?l)) AS ?tag) (langMatches(LANG(STRLANG(?t, ?l)), 'DE') AS ?m) WHERE { ?d documents:doc_id ?k ; documents:lang ?l ; documents:source ?t }", "SELECT doc_id AS k, lang AS tag, lang = 'de' AS m FROM documents"),
    "path_seq": ("SELECT ?k ?r WHERE { ?o orders:o_orderkey ?k ; orders:custRef/customer:nationRef/nation:regionRef/region:r_name ?r }", "SELECT o_orderkey AS k, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inv": ("SELECT ?name ?k WHERE { ?n nation:n_name ?name ; ^customer:nationRef/customer:c_custkey ?k }", "SELECT n_name AS name, c_custkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey"),
    "path_alt": ("SELECT ?k WHERE { ?n nation:n_name 'NATION_3' ; (^customer:nationRef/customer:c_custkey)|(^supplier:nationRef/supplier:s_suppkey) ?k }", "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' UNION ALL SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'"),
    "path_nps": ("SELECT ?o WHERE { <http://tpch/region/2> !(region:r_regionkey|rdf:type) ?o }", "SELECT r_name AS o FROM region WHERE r_regionkey = 2"),
    "graph_named": ("SELECT ?g ?name WHERE { GRAPH ?g { ?x region:r_name ?name } }", "SELECT 'http://tpch/graph/region' AS g, r_name AS name FROM region"),
    "graph_constant": ("SELECT ?p (COUNT(*) AS ?n) WHERE { GRAPH g:nation { ?x ?p ?o } } GROUP BY ?p", "SELECT p, count(*) AS n FROM nation, (VALUES ('http://tpch/nation#n_nationkey'), ('http://tpch/nation#n_name'), ('http://tpch/nation#n_regionkey'), ('http://tpch/nation#regionRef'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) v(p) GROUP BY p"),
    "from_clause": ("SELECT ?name FROM g:region WHERE { { ?x region:r_name ?name } UNION { ?x nation:n_name ?name } }", "SELECT r_name AS name FROM region"),
    "from_named": ("SELECT ?g ?x FROM NAMED g:region WHERE { GRAPH ?g { ?x rdf:type ?t } }", "SELECT 'http://tpch/graph/region' AS g, 'http://tpch/region/' || r_regionkey AS x FROM region"),
    "extend_error": ("SELECT ?k ?bad WHERE { ?r region:r_regionkey ?k ; region:r_name ?n BIND(?n + 1 AS ?bad) }", "SELECT CAST(r_regionkey AS BIGINT) AS k, NULL::VARCHAR AS bad FROM region"),
    "json_props": ("SELECT ?k ?p WHERE { ?e events:event_id ?k ; events:props ?p ; events:event_type 'purchase' }", "SELECT event_id AS k, props AS p FROM events WHERE event_type = 'purchase'"),
    "nop": ("SELECT (1 AS ?one) WHERE { }", "SELECT 1::BIGINT AS one"),
    "cartesian": ("SELECT ?a ?b WHERE { ?x region:r_name ?a . ?y nation:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "theta_join": ("SELECT ?a ?b WHERE { ?x supplier:s_suppkey ?a ; supplier:s_acctbal ?p . ?y region:r_regionkey ?b FILTER(?p > ?b * 2000) }", "SELECT s_suppkey AS a, CAST(r_regionkey AS BIGINT) AS b FROM supplier JOIN region ON s_acctbal > r_regionkey * 2000"),
    "minus_undef": (
        "SELECT ?k WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } MINUS { VALUES ?t { 0 } } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.toxic <> 0",
    ),
    "time_parts": ("SELECT ?k (MINUTES(?t) AS ?m) (xsd:double(SECONDS(?t)) AS ?s) WHERE { ?e events:event_id ?k ; events:ts ?t }", "SELECT event_id AS k, minute(ts) AS m, microsecond(ts) / 1000000.0::DOUBLE AS s FROM events"),
    "date_arithmetic": (
        "SELECT ?k (STR(?d + 'P1DT2H'^^xsd:dayTimeDuration) AS ?a) (STR(?d - 'P1M'^^xsd:yearMonthDuration) AS ?b) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }",
        "SELECT o_orderkey AS k, strftime(o_orderdate + INTERVAL 26 HOUR, '%Y-%m-%dT%H:%M:%S') AS a, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%S') AS b FROM orders",
    ),
    "date_difference": ("SELECT ?k (STR(?d - '1995-01-01T00:00:00'^^xsd:dateTime) AS ?gap) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d FILTER(?d > '1995-01-01T00:00:00'^^xsd:dateTime) }", "SELECT o_orderkey AS k, 'P' || date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) || 'D' AS gap FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01'"),
    "timezones": ("SELECT (TZ('2011-01-10T14:45:13-05:00'^^xsd:dateTime) AS ?a) (STR(TIMEZONE('2011-01-10T14:45:13-05:00'^^xsd:dateTime)) AS ?b) WHERE { }", "SELECT '-05:00' AS a, '-PT5H' AS b"),
    "date_casts": ("SELECT ?k (STR(xsd:date(?d)) AS ?a) (STR(xsd:time(STR(?d))) AS ?b) (STR(xsd:dateTime(STR(?d))) AS ?c) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%H:%M:%S') AS b, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS c FROM orders"),
    "duration_casts": ("SELECT (STR(xsd:dayTimeDuration('P1DT25H')) AS ?a) (STR(xsd:yearMonthDuration('P14M')) AS ?b) (STR(xsd:duration('P1Y')) AS ?c) WHERE { }", "SELECT 'P2DT1H' AS a, 'P1Y2M' AS b, 'P1Y' AS c"),
    "number_casts": ("SELECT ?k (xsd:double(xsd:decimal(STR(?k))) AS ?a) (xsd:double(xsd:float(?k)) AS ?b) (xsd:integer(CONCAT('-', STR(?k))) AS ?c) WHERE { ?p part:p_partkey ?k }", "SELECT p_partkey AS k, CAST(p_partkey AS DOUBLE) AS a, CAST(p_partkey AS DOUBLE) AS b, -p_partkey AS c FROM part"),
    "long_hashes": ("SELECT ?k (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) WHERE { ?s supplier:s_suppkey ?k ; supplier:s_name ?n }", "SELECT s_suppkey AS k, 96::BIGINT AS a, 128::BIGINT AS b FROM supplier"),
    "fresh_values": ("SELECT ?k (STRLEN(STRUUID()) AS ?a) (isIRI(UUID()) AS ?b) (RAND() < 1 AS ?c) (isBLANK(BNODE()) AS ?d) (YEAR(NOW()) > 2000 AS ?e) WHERE { ?r region:r_regionkey ?k }", "SELECT CAST(r_regionkey AS BIGINT) AS k, 36::BIGINT AS a, true AS b, true AS c, true AS d, true AS e FROM region"),
    "typed_literals": (
        "SELECT ?k (STR(DATATYPE(STRDT(?n, xsd:token))) AS ?a) (LANGDIR(STRLANGDIR(?n, 'ar', 'rtl')) AS ?b) (hasLANG(STRLANG(?n, 'en')) AS ?c) (hasLANGDIR(STRLANG(?n, 'en')) AS ?d) WHERE { ?r region:r_regionkey ?k ; region:r_name ?n }",
        "SELECT CAST(r_regionkey AS BIGINT) AS k, 'http://www.w3.org/2001/XMLSchema#token' AS a, 'rtl' AS b, true AS c, false AS d FROM region",
    ),
    "triple_terms": (
        "SELECT ?k (SUBJECT(?t) AS ?s) (PREDICATE(?t) AS ?p) (OBJECT(?t) AS ?o) (isTRIPLE(?t) AS ?i) WHERE { ?r region:r_regionkey ?k ; region:r_name ?n BIND(TRIPLE(?r, region:r_name, ?n) AS ?t) }",
        "SELECT CAST(r_regionkey AS BIGINT) AS k, 'http://tpch/region/' || r_regionkey AS s, 'http://tpch/region#r_name' AS p, r_name AS o, true AS i FROM region",
    ),
    "logic": ("SELECT ?k ((?z > 10 && ?z < 20) AS ?a) ((?z > 40 || !(?z = 1)) AS ?b) WHERE { ?p part:p_partkey ?k ; part:p_size ?z }", "SELECT p_partkey AS k, p_size > 10 AND p_size < 20 AS a, p_size > 40 OR NOT p_size = 1 AS b FROM part"),
    "comparisons": ("SELECT ?k (?z != 5 AS ?a) (?z <= 7 AS ?b) (?n >= 'p' AS ?c) (-?z + +1 AS ?d) WHERE { ?p part:p_partkey ?k ; part:p_size ?z ; part:p_name ?n }", "SELECT p_partkey AS k, p_size <> 5 AS a, p_size <= 7 AS b, p_name >= 'p' AS c, CAST(-p_size + 1 AS BIGINT) AS d FROM part"),
    "group_concat_distinct": ("SELECT ?s (GROUP_CONCAT(DISTINCT ?p; SEPARATOR='|') AS ?all) WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderpriority ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS all FROM orders GROUP BY 1"),
    "aggregate_error": ("SELECT ?t (SUM(?v) AS ?bad) (COUNT(?v) AS ?n) WHERE { ?e events:event_type ?t ; ?p ?v FILTER(?p IN (events:value, events:event_type)) } GROUP BY ?t", "SELECT event_type AS t, NULL::VARCHAR AS bad, 2 * count(*) AS n FROM events GROUP BY 1"),
    "aggregate_unbound": ("SELECT ?g (COUNT(?q) AS ?n) (SUM(?q) AS ?s) WHERE { ?d documents:lang ?g OPTIONAL { ?l labels:docRef ?d ; labels:quality ?q } } GROUP BY ?g", "SELECT lang AS g, count(quality) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "avg_distinct": ("SELECT (ROUND(AVG(DISTINCT ?p)) AS ?m) (xsd:double(AVG(?z)) AS ?w) WHERE { ?x part:p_retailprice ?p ; part:p_size ?z }", "SELECT floor(avg(DISTINCT p_retailprice) + 0.5) AS m, avg(p_size) AS w FROM part"),
    "filter_iri": ("SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:custRef ?c FILTER(?c = <http://tpch/customer/11>) }", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 11"),
    "nested_select": ("SELECT ?name ?n WHERE { ?x nation:n_name ?name { SELECT ?x (COUNT(*) AS ?n) WHERE { ?s supplier:nationRef ?x } GROUP BY ?x HAVING(COUNT(*) > 1) } }", "SELECT n_name AS name, n FROM nation JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1) ON s_nationkey = n_nationkey"),
    "exists_in_optional": (
        "SELECT ?k ?q WHERE { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:quality ?q FILTER EXISTS { ?d documents:lang 'en' } } }",
        "SELECT d.doc_id AS k, CAST(l.quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.lang = 'en'",
    ),
    "types": ("SELECT ?t (COUNT(*) AS ?n) WHERE { ?x a ?t FILTER(?t IN (t:region, t:nation, t:part)) } GROUP BY ?t", "SELECT 'http://tpch/region' AS t, count(*) AS n FROM region UNION ALL SELECT 'http://tpch/nation', count(*) FROM nation UNION ALL SELECT 'http://tpch/part', count(*) FROM part"),
}


def sparql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: Engine.over_tables(spark, d).query(text)


EDGE, CHAIN = "http://tpch/tree#parent", "http://tpch/tree#next"
#: Nodes of a chain.
CHAIN_NODES = 300


def tree(spark: SparkSession, d: str, chain: bool = False) -> DataFrame:
    """Quads: each customer's parent is the one with half its number; or a chain of nodes."""
    node = lambda c: term_col(IRI, F.concat(F.lit("http://tpch/customer/"), c.cast("string")))
    k = F.col("c_custkey")
    found = spark.read.parquet(f"{d}/customer.parquet").where(k > 1).select(node(k).alias("s"), F.lit(EDGE).alias("p"), node(F.shiftright(k, 1)).alias("o"), F.lit("").alias("g"))
    i = F.col("id")
    return found if not chain else spark.range(1, CHAIN_NODES).select(node(i).alias("s"), F.lit(CHAIN).alias("p"), node(i + 1).alias("o"), F.lit("").alias("g"))


def over_tree(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: Engine(spark, QuadSource(tree(spark, d, CHAIN in text))).query(text)


_TREE_SQL = "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) "
_IRI = "'http://tpch/customer/' || "
PATHS = {
    "path_plus": (f"SELECT ?a ?b WHERE {{ ?a <{EDGE}>+ ?b }}", f"{_TREE_SQL} SELECT {_IRI}a AS a, {_IRI}b AS b FROM c"),
    "path_star": (f"SELECT ?a ?b WHERE {{ ?a <{EDGE}>* ?b }}", f"{_TREE_SQL} SELECT {_IRI}a AS a, {_IRI}b AS b FROM (SELECT a, b FROM c UNION SELECT n, n FROM (SELECT a AS n FROM e UNION SELECT b FROM e))"),
    "path_plus_long": (f"SELECT ?b WHERE {{ ?a <{CHAIN}>+ ?b }}", f"SELECT {_IRI}CAST(b AS VARCHAR) AS b FROM range(1, 300) t(a), range(2, 301) u(b) WHERE b > a"),
    "path_opt": (f"SELECT ?a ?b WHERE {{ ?a <{EDGE}>? ?b }}", f"{_TREE_SQL} SELECT {_IRI}a AS a, {_IRI}b AS b FROM (SELECT a, b FROM e UNION SELECT n, n FROM (SELECT a AS n FROM e UNION SELECT b FROM e))"),
    "path_from_constant": (f"SELECT ?b WHERE {{ <http://tpch/customer/100> <{EDGE}>+ ?b }}", f"{_TREE_SQL} SELECT {_IRI}b AS b FROM c WHERE a = 100"),
    "path_to_constant": (f"SELECT ?a WHERE {{ ?a <{EDGE}>* <http://tpch/customer/5> }}", f"{_TREE_SQL} SELECT {_IRI}a AS a FROM (SELECT a FROM c WHERE b = 5 UNION SELECT 5)"),
}


def ask(spark: SparkSession, d: str) -> DataFrame:
    found = Engine.over_tables(spark, d).query("ASK { ?x nation:n_name 'NATION_3' }")
    return spark.createDataFrame([(found,)], "answer boolean")


def construct(spark: SparkSession, d: str) -> DataFrame:
    q = Engine.over_tables(spark, d).query("CONSTRUCT { ?c <http://x/livesIn> ?n . ?n <http://x/called> ?name } WHERE { ?c customer:nationRef ?n . ?n nation:n_name ?name FILTER(?name = 'NATION_4') }")
    return q.select(n3_col(F.col("s")).alias("s"), "p", n3_col(F.col("o")).alias("o"))


def describe(spark: SparkSession, d: str) -> DataFrame:
    q = Engine.over_tables(spark, d).query("DESCRIBE ?r WHERE { ?r region:r_name 'ASIA' }")
    return q.select(n3_col(F.col("s")).alias("s"), "p", n3_col(F.col("o")).alias("o"))


def update_insert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Regions are loaded into a store, one is renamed, one deleted, one graph copied."""
    tables = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    store = Store(spark, tables.quads(["region"], named=False))
    e = Engine(spark, store, prefixes={"region": "http://tpch/region#", "t": "http://tpch/"})
    e.update("""DELETE { ?r region:r_name ?n } INSERT { ?r region:r_name 'ORIENT' } WHERE { ?r region:r_name ?n FILTER(?n = 'ASIA') } ;
      DELETE WHERE { <http://tpch/region/0> ?p ?o } ; INSERT DATA { GRAPH t:extra { <http://tpch/region/9> region:r_name 'NOWHERE' } } ; ADD t:extra TO DEFAULT""")
    return e.query("SELECT ?r ?n WHERE { ?r region:r_name ?n }")


def boxed_terms(spark: SparkSession, d: str) -> DataFrame:
    r = Engine.over_tables(spark, d).bindings("SELECT ?r ?k ?n WHERE { ?r region:r_regionkey ?k ; region:r_name ?n }")
    return r.select(*[n3_col(F.col(c)).alias(c) for c in r.columns])


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    """A pattern may match in either source, and a join may go across."""
    e = Engine.over_tables(spark, d)
    e.sources.append(QuadSource(tree(spark, d)))
    return e.query(f"SELECT ?name ?up WHERE {{ ?c customer:c_name ?name ; <{EDGE}> ?p . ?p customer:c_name ?up }}")


def service(spark: SparkSession, d: str) -> DataFrame:
    e = Engine.over_tables(spark, d, services={"http://tree/": [QuadSource(tree(spark, d))]})
    return e.query(f"SELECT ?name ?p WHERE {{ ?c customer:c_name ?name SERVICE <http://tree/> {{ ?c <{EDGE}> ?p }} }}")


def _store(spark: SparkSession, d: str, tables: list[str], **options) -> tuple[Store, Engine]:  # noqa: ANN003
    source = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    store = Store(spark, source.quads(tables))
    prefixes = {"t": "http://tpch/", "g": "http://tpch/graph/", "region": "http://tpch/region#", "nation": "http://tpch/nation#"}
    return store, Engine(spark, store, prefixes=prefixes, **options)


def _sizes(store: Store) -> DataFrame:
    return store.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def update_graphs(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Quads in each graph, after an update of a store with the graphs of region and nation."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        store, e = _store(spark, d, ["region", "nation"], load=lambda s: TableSource(lambda n: spark.read.parquet(f"{d}/{n}.parquet")).quads(["supplier"]))
        e.update(text)
        return _sizes(store)

    return run


def initial_bindings(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_tables(spark, d).query("SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderstatus ?s }", {"s": literal("F")})


def union_default_graph(spark: SparkSession, d: str) -> DataFrame:
    source = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    e = Engine(spark, QuadSource(source.quads(["region", "nation"]), union_default=True), prefixes={"r": "http://tpch/region#", "n": "http://tpch/nation#"})
    return e.query("SELECT ?a ?b WHERE { ?x n:n_name ?a ; n:regionRef ?y . ?y r:r_name ?b }")


def nquads_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as N-Quads, read again, queried."""
    path = shared_dir(spark)
    write_nquads(TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet")).quads(["customer"]), path)
    e = Engine(spark, read_rdf(spark, path, "application/n-quads"), prefixes={"c": "http://tpch/customer#"})
    return e.query("SELECT ?k ?n ?s WHERE { GRAPH <http://tpch/graph/customer> { ?x c:c_custkey ?k ; c:c_name ?n ; c:c_mktsegment ?s } }")


def turtle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    quads = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet")).quads(["nation"], named=False)
    e = Engine(spark, from_text(spark, turtle_text(quads, {"n": "http://tpch/nation#"})), prefixes={"n": "http://tpch/nation#"})
    return e.query("SELECT ?k ?name WHERE { ?x n:n_nationkey ?k ; n:n_name ?name ; n:regionRef <http://tpch/region/1> }")


def jsonld_round_trip(spark: SparkSession, d: str) -> DataFrame:
    quads = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet")).quads(["region"], named=False)
    e = Engine(spark, from_text(spark, jsonld_text(quads), "application/ld+json"), prefixes={"r": "http://tpch/region#"})
    return e.query("SELECT ?x ?name WHERE { ?x r:r_name ?name }")


def turtle_write(spark: SparkSession, d: str) -> DataFrame:
    """Written as TriG by many tasks, read again, queried."""
    path = shared_dir(spark)
    tables = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    write_turtle(tables.quads(["customer"]), path, {"c": "http://tpch/customer#"}, 2000)
    e = Engine(spark, read_rdf(spark, path, "application/trig"), prefixes={"c": "http://tpch/customer#"})
    return e.query("SELECT ?k ?n ?s WHERE { GRAPH <http://tpch/graph/customer> { ?x c:c_custkey ?k ; c:c_name ?n ; c:c_mktsegment ?s } }")


def jsonld_write(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark)
    write_jsonld(TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet")).quads(["customer"], named=False), path, 2000)
    e = Engine(spark, read_rdf(spark, path, "application/ld+json"), prefixes={"c": "http://tpch/customer#"})
    return e.query("SELECT ?k ?n WHERE { ?x c:c_custkey ?k ; c:c_name ?n ; c:nationRef <http://tpch/nation/3> }")


def documents_of(kind: str, write: Callable[[list], str], of: str = "nation") -> Callable[[SparkSession, str], DataFrame]:
    """A document for each region, about its nations, read by one format's parser."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = spark.read.parquet(f"{d}/nation.parquet")
        rows = t.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
        found = [write([(n["n_nationkey"], n["n_name"], r["n_regionkey"]) for n in r["n"]]) for r in rows.collect()]
        df = spark.createDataFrame([(x, "http://doc/") for x in found], "text string, base string")
        e = Engine(spark, read_column(df, "text", kind, "base"), prefixes={"x": "http://x/"})
        return e.query("SELECT ?n ?name ?r WHERE { ?n x:name ?name ; x:region ?r }")

    return run


def _rdfxml(ns: list) -> str:
    return f'<r:RDF xmlns:r="{_RDF}" xmlns:x="http://x/">' + "".join(f'<r:Description r:about="http://n/{k}"><x:name>{n}</x:name><x:region r:resource="http://r/{g}"/></r:Description>' for k, n, g in ns) + "</r:RDF>"


def _rdfa(ns: list) -> str:
    return "<html><body prefix='x: http://x/'>" + "".join(f'<p about="http://n/{k}"><b property="x:name">{n}</b><a rel="x:region" href="http://r/{g}">r</a></p>' for k, n, g in ns) + "</body></html>"


def _microdata(ns: list) -> str:
    return "<html><body>" + "".join(f'<div itemscope itemid="http://n/{k}"><i itemprop="http://x/name">{n}</i><a itemprop="http://x/region" href="http://r/{g}">r</a></div>' for k, n, g in ns) + "</body></html>"


def _script(ns: list) -> str:
    return "<html><head><script type='text/turtle'>" + " ".join(f'<http://n/{k}> <http://x/name> "{n}" ; <http://x/region> <http://r/{g}> .' for k, n, g in ns) + "</script></head></html>"


_DOCUMENTS_SQL = "SELECT 'http://n/' || n_nationkey AS n, n_name AS name, 'http://r/' || n_regionkey AS r FROM nation"


def composite_file(spark: SparkSession, d: str) -> DataFrame:
    """Several files of unlike formats as one source."""
    a, b = shared_dir(spark), shared_dir(spark)
    tables = TableSource(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    write_nquads(tables.quads(["region"], named=False), f"{a}.nq")
    write_turtle(tables.quads(["nation"], named=False), f"{b}.ttl")
    e = Engine(spark, read_rdf(spark, [f"{a}.nq", f"{b}.ttl"]), prefixes={"n": "http://tpch/nation#", "r": "http://tpch/region#"})
    return e.query("SELECT ?a ?b WHERE { ?x n:n_name ?a ; n:regionRef ?y . ?y r:r_name ?b }")


def parsed_result(write: Callable[[DataFrame], str], read: Callable[[str], list]) -> Callable[[SparkSession, str], DataFrame]:
    """Regions in a result format, taken apart again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = Engine.over_tables(spark, d).bindings("SELECT ?x ?n WHERE { ?x region:r_name ?n }")
        return spark.createDataFrame(read(write(found)), "x string, n string")

    return run


def _of_json(text: str) -> list:
    return [(b["x"]["value"], b["n"]["value"]) for b in json.loads(text)["results"]["bindings"]]


def _of_xml(text: str) -> list:
    ns = "{http://www.w3.org/2005/sparql-results#}"
    return [tuple(b[0].text for b in r) for r in ElementTree.fromstring(text.encode()).iter(f"{ns}result")]


def _of_table(text: str) -> list:
    return [(x[:24].strip(), x[25:].strip()) for x in text.splitlines()[2:]]


def _of_tree(text: str) -> list:
    return [(x["x"][0], x["n"][0]) for x in json.loads(text)]


def _served(spark: SparkSession, d: str, use: Callable[[str], DataFrame], **options) -> DataFrame:  # noqa: ANN003
    """A result got from an endpoint over the tables, which is there only while it is asked."""
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = serve(Engine.over_tables(spark, d, **options), 0, host)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        return use(f"http://{host}:{server.server_address[1]}/sparql")
    finally:
        server.shutdown()


def service_http(spark: SparkSession, d: str) -> DataFrame:
    """SERVICE with an address: one request with the whole group."""
    text = "SELECT ?name ?s WHERE { ?n nation:n_name ?name SERVICE <%s> { ?x supplier:nationRef ?n ; supplier:s_name ?s ; supplier:s_acctbal ?b FILTER(?b > 1000) } }"
    return _served(spark, d, lambda url: Engine.over_tables(spark, d).query(text % url))


def endpoint_source(spark: SparkSession, d: str) -> DataFrame:
    """An endpoint as the source: stars are queries there, and solutions found go with the next one."""
    prefixes = Engine.over_tables(spark, d).prefixes
    return _served(spark, d, lambda url: Engine(spark, url, prefixes=prefixes).query("SELECT ?name ?r WHERE { ?n nation:n_name ?name ; nation:regionRef ?g . ?g region:r_name ?r }"))


def csv_result(spark: SparkSession, d: str) -> DataFrame:
    return csv_lines(Engine.over_tables(spark, d).bindings("SELECT ?x ?n WHERE { ?x supplier:s_name ?n }"))


def tsv_result(spark: SparkSession, d: str) -> DataFrame:
    return tsv_lines(Engine.over_tables(spark, d).bindings("SELECT ?k ?n WHERE { ?x supplier:s_suppkey ?k ; supplier:s_name ?n }"))


def nquads_result(spark: SparkSession, d: str) -> DataFrame:
    return nquads_lines(Engine.over_tables(spark, d).query("CONSTRUCT { ?x <http://x/name> ?n } WHERE { ?x supplier:s_name ?n }"))


def graphql(spark: SparkSession, d: str) -> DataFrame:
    e = Engine.over_tables(spark, d)
    context = {"name": "http://tpch/nation#n_name", "region": "http://tpch/nation#regionRef", "called": "http://tpch/region#r_name", "suppliers": {"@reverse": "http://tpch/supplier#nationRef"}, "label": "http://tpch/supplier#s_name"}
    e.parse = lambda text: parse_graphql(text, context)
    return e.query("{ name region { called } suppliers @optional { label } }")


def distinct_construct(spark: SparkSession, d: str) -> DataFrame:
    q = Engine.over_tables(spark, d, distinct_construct=True).query("CONSTRUCT { ?n <http://x/in> ?r } WHERE { ?c customer:nationRef ?n . ?n nation:regionRef ?r }")
    return q.select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def opt_plus(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_tables(spark, d, opt_plus=True).query("SELECT ?n ?k WHERE { ?x nation:n_name ?n OPTIONAL { ?s supplier:nationRef ?x ; supplier:s_suppkey ?k } }")


def extension_function(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_tables(spark, d, extensions={"http://x/reverse": F.reverse}).query("SELECT ?k (<http://x/reverse>(?n) AS ?r) WHERE { ?x region:r_regionkey ?k ; region:r_name ?n }")


def service_silent(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_tables(spark, d).query("SELECT ?n WHERE { ?x region:r_name ?n SERVICE SILENT <http://nowhere/> { ?x ?p ?o } }")


def full_term_comparison(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_tables(spark, d, full_term_comparison=True).query("SELECT ?n WHERE { ?x region:r_name ?n FILTER(?x > <http://tpch/region/2>) }")


def serialized(spark: SparkSession, d: str) -> DataFrame:
    """A query is read, written as text again, and that is run."""
    e = Engine.over_tables(spark, d)
    return e.query(e.explain(SPARQL["optional_expr"][0], "sparql"))


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_REGIONS_SQL = "SELECT 'http://tpch/region/' || r_regionkey AS x, r_name AS n FROM region"
_INT = '"^^<http://www.w3.org/2001/XMLSchema#integer>'
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ask": (ask, "SELECT count(*) > 0 AS answer FROM nation WHERE n_name = 'NATION_3'"),
    "construct": (
        construct,
        "SELECT '<http://tpch/customer/' || c_custkey || '>' AS s, 'http://x/livesIn' AS p, '<http://tpch/nation/' || n_nationkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4' UNION ALL SELECT '<http://tpch/nation/' || n_nationkey || '>', 'http://x/called', '\"' || n_name || '\"' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4'",
    ),
    "describe": (
        describe,
        f"SELECT s, p, o FROM (SELECT '<http://tpch/region/' || r_regionkey || '>' AS s, unnest([{{'p': 'http://tpch/region#r_name', 'o': '\"ASIA\"'}}, {{'p': 'http://tpch/region#r_regionkey', 'o': '\"' || r_regionkey || '{_INT}'}}, {{'p': '{_RDF}type', 'o': '<http://tpch/region>'}}], recursive := true) FROM region WHERE r_name = 'ASIA')",
    ),
    "update_insert_delete": (
        update_insert_delete,
        "SELECT 'http://tpch/region/' || r_regionkey AS r, CASE WHEN r_name = 'ASIA' THEN 'ORIENT' ELSE r_name END AS n FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 'http://tpch/region/9', 'NOWHERE'",
    ),
    "boxed_terms": (boxed_terms, f"SELECT '<http://tpch/region/' || r_regionkey || '>' AS r, '\"' || r_regionkey || '{_INT}' AS k, '\"' || r_name || '\"' AS n FROM region"),
    "two_sources": (two_sources, "SELECT a.c_name AS name, b.c_name AS up FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 2 WHERE a.c_custkey > 1"),
    "initial_bindings": (initial_bindings, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'"),
    "union_default_graph": (union_default_graph, "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "update_clear": (update_graphs("CLEAR GRAPH g:region"), "SELECT 'http://tpch/graph/nation' AS g, 5 * count(*) AS n FROM nation"),
    "update_drop_create": (update_graphs("DROP GRAPH g:nation ; CREATE GRAPH g:new ; DROP SILENT GRAPH g:none"), "SELECT 'http://tpch/graph/region' AS g, 3 * count(*) AS n FROM region"),
    "update_copy": (update_graphs("COPY g:region TO g:nation"), "SELECT unnest(['http://tpch/graph/region', 'http://tpch/graph/nation']) AS g, 3 * count(*) AS n FROM region"),
    "update_move": (update_graphs("MOVE g:nation TO DEFAULT"), "SELECT '' AS g, 5 * count(*) AS n FROM nation UNION ALL SELECT 'http://tpch/graph/region', 3 * count(*) FROM region"),
    "update_add": (update_graphs("ADD g:region TO g:nation"), "SELECT 'http://tpch/graph/nation' AS g, 5 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region) AS n UNION ALL SELECT 'http://tpch/graph/region', 3 * count(*) FROM region"),
    "update_load": (update_graphs("DROP ALL ; LOAD <doc> INTO GRAPH g:loaded"), "SELECT 'http://tpch/graph/loaded' AS g, 6 * count(*) AS n FROM supplier"),
    "update_where": (update_graphs("WITH g:nation DELETE { ?x nation:regionRef ?r } INSERT { GRAPH g:links { ?x t:in ?r } } WHERE { ?x nation:regionRef ?r }"), "SELECT 'http://tpch/graph/nation' AS g, 4 * count(*) AS n FROM nation UNION ALL SELECT 'http://tpch/graph/links', count(*) FROM nation UNION ALL SELECT 'http://tpch/graph/region', 3 * count(*) FROM region"),
    "nquads_round_trip": (nquads_round_trip, "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n, c_mktsegment AS s FROM customer"),
    "turtle_round_trip": (turtle_round_trip, "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation WHERE n_regionkey = 1"),
    "jsonld_round_trip": (jsonld_round_trip, "SELECT 'http://tpch/region/' || r_regionkey AS x, r_name AS name FROM region"),
    "csv_result": (csv_result, "SELECT 'http://tpch/supplier/' || s_suppkey || ',' || s_name AS value FROM supplier"),
    "tsv_result": (tsv_result, "SELECT s_suppkey || chr(9) || '\"' || s_name || '\"' AS value FROM supplier"),
    "nquads_result": (nquads_result, "SELECT '<http://tpch/supplier/' || s_suppkey || '> <http://x/name> \"' || s_name || '\" .' AS value FROM supplier"),
    "graphql": (graphql, "SELECT n_name AS name, r_name AS region_called, s_name AS suppliers_label FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "distinct_construct": (distinct_construct, "SELECT DISTINCT 'http://tpch/nation/' || n_nationkey AS s, 'http://x/in' AS p, 'http://tpch/region/' || n_regionkey AS o FROM nation JOIN customer ON c_nationkey = n_nationkey"),
    "opt_plus": (opt_plus, "SELECT n_name AS n, NULL::BIGINT AS k FROM nation UNION ALL SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "extension_function": (extension_function, "SELECT CAST(r_regionkey AS BIGINT) AS k, reverse(r_name) AS r FROM region"),
    "service_silent": (service_silent, "SELECT r_name AS n FROM region"),
    "full_term_comparison": (full_term_comparison, "SELECT r_name AS n FROM region WHERE r_regionkey > 2"),
    "serialized": (serialized, SPARQL["optional_expr"][1]),
    "turtle_write": (turtle_write, "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n, c_mktsegment AS s FROM customer"),
    "jsonld_write": (jsonld_write, "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n FROM customer WHERE c_nationkey = 3"),
    "rdfxml_documents": (documents_of("application/rdf+xml", _rdfxml), _DOCUMENTS_SQL),
    "rdfa_documents": (documents_of("text/html", _rdfa), _DOCUMENTS_SQL),
    "microdata_documents": (documents_of("text/html", _microdata), _DOCUMENTS_SQL),
    "html_scripts": (documents_of("text/html", _script), _DOCUMENTS_SQL),
    "composite_file": (composite_file, "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sparql_json_result": (parsed_result(sparql_json_text, _of_json), _REGIONS_SQL),
    "sparql_xml_result": (parsed_result(sparql_xml_text, _of_xml), _REGIONS_SQL),
    "table_result": (parsed_result(table_text, _of_table), _REGIONS_SQL),
    "tree_result": (parsed_result(tree_text, _of_tree), _REGIONS_SQL),
    "service_http": (service_http, "SELECT n_name AS name, s_name AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 1000"),
    "endpoint_source": (endpoint_source, "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "service": (service, f"SELECT c_name AS name, {_IRI}(c_custkey // 2) AS p FROM customer WHERE c_custkey > 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: sparql(t) for k, (t, _) in SPARQL.items()} | {k: over_tree(t) for k, (t, _) in PATHS.items()} | {k: f for k, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (*SPARQL.items(), *PATHS.items(), *OTHER.items())}
