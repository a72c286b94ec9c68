"""The pipeline's stages, each against a plain version on its own input; SQL twins; the guard."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import brute
import pytest

import corpus_pipeline
from quadspark.llm import mixing, queries, toxicity
from quadspark.llm.common import table, written


def test_stages_on_their_own_inputs(spark, sf):
    docs = table(spark, sf, "documents")
    scorer = toxicity.Scorer(*toxicity.fit(docs, table(spark, sf, "labels")))
    seen, inputs = docs, []
    for name, f in corpus_pipeline.STAGES:
        inputs.append((name, [tuple(r) for r in seen.collect()]))
        seen = written(f(spark, seen, sf))
        if name != "packing":
            assert seen.columns == docs.columns, name
    inputs.append(("result", None))
    by = dict(inputs)
    assert brute.counted(by["line_dedup"]) == brute.counted(r for r in by["toxicity"] if scorer(r[1]) < 0.5)
    lines = brute.line_dedup([(r[0], r[1]) for r in by["line_dedup"]])
    assert brute.counted((r[0], r[1]) for r in by["simhash_near_dedup"]) == brute.counted((i, t) for i, _, _, t in lines)
    assert brute.counted(r[0] for r in by["mixing"]) == brute.counted(brute.similar([(r[0], r[1]) for r in by["simhash_near_dedup"]]))
    mixed = defaultdict(int)
    for r in by["packing"]:
        mixed[r[0]] += 1
    plan = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(by["mixing"], docs.schema)).collect()}
    assert dict(mixed) == {i: n for i, n in plan.items() if n}
    ends = sum(r.length for r in seen.collect() if r.start + r.length == r.doc_tokens and r.length) and sum(1 for r in seen.collect() if r.start + r.length == r.doc_tokens)
    assert ends == len(by["packing"])
    assert brute.counted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "doc_tokens").groupBy("doc_id").sum("length").collect())) == brute.counted(map(tuple, seen.groupBy("doc_id").sum("length").collect()))


def test_stages_take_awkward_rows(spark, wide, empty, sf):
    for rows in (wide, empty):
        docs = rows
        for _, f in corpus_pipeline.STAGES:
            docs = written(f(spark, docs, sf))
        assert (docs.count() > 0) == (rows is wide)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    from compare import connect, differences

    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name]) == ""


def test_rest_works_without_these_folders(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for p in ("quadspark", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quadspark/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
