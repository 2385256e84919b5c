"""The pipeline and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import duck_rows, spark_rows
from llm_fixtures import documents, near_components, table
from panewise.llm import secrets
from panewise.llm.registry import QUERIES

SQL = [n for n, q in QUERIES.items() if q.sql is not None]


def test_all_queries_are_entries():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, sf_small, name):
    assert spark_rows(QUERIES[name].run(spark, sf_small)) == duck_rows(sf_small, QUERIES[name].sql)


def test_stages(spark, tmp_path):
    """Each stage's decisions against plain Python, on the rows its predecessor kept."""
    rows, docs = documents(), table(spark)
    columns, seen = docs.columns, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "redact_secrets", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
            seen[name] = docs.select("doc_id", "text", "lang", "n_chars").collect()
    texts = lambda name: sorted(((r.doc_id, r.text) for r in seen[name]), key=repr)
    assert texts("language") == sorted(((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)
    assert all(r.lang is not None for r in seen["language"])
    assert [i for i, _ in texts("line_dedup")] == [i for i, _ in texts("language")]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    lines = [(r.doc_id, r.text) for r in seen["line_dedup"]]
    found = near_components([t for _, t in lines], 5, 80, 100)
    least = {}
    for (i, _), (n, label) in zip(lines, found):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    stay = [x for x, (n, label) in zip(lines, found) if not n or x[0] is None or least[label] == x[0]]
    assert texts("near_duplicates") == sorted(stay, key=repr)
    want = [(i, secrets.redacted(t, secrets.find(t)[1]) if t else t) for i, t in stay]
    assert texts("redact_secrets") == sorted(want, key=repr)
    assert "hunter2" not in str(want) and all(r.n_chars == len(r.text) for r in seen["redact_secrets"])
    assert sorted({r.doc_id for r in docs.collect()}, key=repr) == sorted({i for i, _ in want}, key=repr)


def test_stages_bear_an_empty_table(spark, tmp_path):
    docs = table(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        assert os.path.isdir(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        assert docs.count() == 0


def test_run(spark, sf_small):
    got = corpus_pipeline.run(spark, sf_small)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 50
