"""Positional index, whitening and Merkle manifest against plain Python and numpy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from llm_fixtures import SCHEMA, documents, table
from panewise.llm import merkle, positions, whitening
from panewise.llm.common import Scratch
from panewise.llm.registry import QUERIES
from test_llm_tables import in_duckdb

# Positional index --------------------------------------------------------------------------------------

ITEMS = "item_id bigint, text string, words string, term int"


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items, size):
    windows = {}
    for id, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(id)
    out = []
    for id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        names = sorted(map(str, found))
        out.append((id, len(w), len(hit), len(names), names, bool(hit)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(5)
    docs = [(r[0], r[1]) for r in documents()]
    common = ["the"] * 14
    items = [(i, " ".join(plain_words(docs[3 + i][1])[4 : 4 + n])) for i, n in enumerate([1, 2, 9, 10, 11, 25])]
    items += [(10, "The the THE " * 5), (11, ""), (12, None), (13, "!?"), (None, items[3][1]), (3, items[5][1]), (14, "nowhere at all")]
    items += [items[4], (15, items[4][1].upper() + " 日本語 zz9")]
    docs += [(200, " ".join(common)), (201, " ".join(common[:9])), (202, f"x, {items[5][1].upper()}; {items[5][1]}"), (200, " ".join(common))]
    docs += [(203, " ".join(rng.choice(["the", "a"]) for _ in range(3000)) + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contamination_is_that_of_all_windows(spark, tmp_path, sent, monkeypatch):
    monkeypatch.setattr(positions, "SENT_ROWS", sent)
    docs, items = planted()
    d = table(spark, [(i, t, "en", "s", 0) for i, t in docs])
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    found = positions.contamination(d, b).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_contamination(docs, items, 10)
    if sent:
        query = positions.contamination(d, b)
        query = query.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")
        assert spark_rows(query) == in_duckdb(spark, tmp_path, QUERIES["op11_positional_index"].sql, documents=d, benchmark=b)


def test_no_documents_and_no_items(spark):
    docs, items = planted()
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    assert positions.contamination(table(spark, []), b).collect() == []
    found = positions.contamination(table(spark), b.limit(0)).collect()
    assert len(found) == len(documents()) and not any(r.contaminated or r.n_hit or r.n_items for r in found)


def test_words_near_each_other(spark):
    texts = ["a b c d", "c x a y b", "c x x a y b", "b c", "a a b c a", None, "c b a " * 30]
    asked = [(0, ["a", "b", "c"]), (1, ["a", "a"]), (2, ["none", "a"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame(asked, "phrase int, words array<string>")
    scratch = Scratch(spark, "near")
    index = positions.build(docs, queries, scratch)
    found = positions.near_matches(index, queries, 5, scratch).join(index.heads, "key")
    got = {(r.phrase, r.id, r.start) for r in found.collect()}
    want = set()
    for p, terms in asked:
        for i, text in enumerate(texts):
            w = plain_words(text)
            want |= {(p, i, s) for s in range(len(w)) if w[s] in terms and set(terms) <= set(w[s : s + 5])}
    assert got == want and len(want) > 60


# Whitening ---------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, n int, x string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows], VECTORS).repartition(3)


def plain_whitening(rows, most=16):
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    centred = fit - fit.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    sums = [int(s) for s in fit.sum(0)]
    out = {}
    for i, x in kept:
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x) - fit.mean(0)) @ u / np.sqrt(e)
        out.setdefault(i, []).append((len(fit), deviation, w, e))
    return out, float(np.trace(centred.T @ centred / len(fit)))


def test_whitened_vectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(20, 20)) * np.geomspace(3, 0.05, 20)
    rows = [(i, (rng.normal(size=20) @ mix + 5).tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), rows[1], (None, rows[2][1]), (401, None), (402, [None] * 20), (403, [float("nan")] * 20)]
    rows += [(404, [float("inf")] + [0.0] * 19)]
    want, trace = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 403 * 16
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert r.n == 400 and r.identity_error < 1e-9
    sign = None
    for i, components in by_row.items():
        copies = want[i]
        assert sorted(components) == list(range(1, 17))
        for n, deviation, w, e in copies:
            first = [components[k][0] for k in range(1, 17)]
            assert [c.deviation for c in first] == [deviation] * 16
            whitened = np.array([c.whitened for c in first])
            sign = np.sign(whitened * w) if sign is None else sign
            assert np.allclose(whitened, sign * w, atol=1e-8)
            assert np.allclose([c.explained for c in first], e / trace, rtol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, [])]])
def test_no_direction_varies(spark, rows):
    assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_dimensions_that_depend_on_each_other_or_are_short_or_wide(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)] + [(9, [1.0]), (10, [2.0**60, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted({r.vec_id for r in got}) == list(range(10))  # an entry of 2^60 has no x
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    wide = whitening.whiten(vectors(spark, [(i, [i * 2.0**40, 0.5 * i * i]) for i in range(50)])).collect()
    assert max(r.identity_error for r in wide) < 1e-4 and all(r.deviation is None for r in wide if r.vec_id in (0, 49))


@pytest.mark.parametrize("n,rank", [(1, 1), (5, 5), (12, 7), (33, 33)])
def test_factor_and_rotation(n, rank):
    rng = np.random.default_rng(n)
    half = rng.normal(size=(n, rank)) * np.geomspace(1, 1e-3, rank)
    a = half @ half.T
    g = whitening.pivoted_cholesky(a)
    assert g.shape[1] == rank and np.allclose(g @ g.T, a, atol=1e-12)
    values, components = whitening.jacobi(g)
    assert np.allclose(components.T @ components, np.eye(rank), atol=1e-10)
    assert np.allclose(components * values @ components.T, a, atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9)
    assert sorted((a, b) for left, right in whitening._rounds(n) for a, b in zip(left, right)) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_sums_are_exact():
    y = np.random.default_rng(1).integers(-(1 << 45), 1 << 45, size=(30, 3))
    for part in (y, y >> 30):
        assert (whitening._exact_products(part) == part.astype(object).T @ part.astype(object)).all()


# Merkle manifest ---------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """The last node, and the (left, right) siblings of each node, lowest level first."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = nodes[i - i % 16 : i - i % 16 + 16]
            p.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    """Of rows (doc_id, text, lang, source, n_chars)."""
    leaves = [(r[0], plain_leaf((r[0], r[3], r[2], r[4], r[1])), r) for r in rows]
    groups = {}
    for d in leaves:
        groups.setdefault(d[2][3], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for name in names:
        groups[name].sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        top, paths = plain_tree([d[1] for d in groups[name]])
        tops.append(top)
        inner[name] = paths
    root, outer = plain_tree(tops)
    out = []
    for name, top, over in zip(names, tops, outer):
        for (id, node, r), own in zip(groups[name], inner[name]):
            path, up = own + over, node
            if id is not None and zlib.crc32(str(id).encode()) % 5 == 0 and r[1] is not None:
                up = plain_leaf((r[0], r[3], r[2], r[4], re.sub("[A-Z]", lambda m: m[0].lower(), r[1])))
            for left, right in path:
                up = h(left, up, right)
            out.append((id, node, top, root, h(*(a + b for a, b in path)), up, up == root))
    return sorted(out, key=repr)


def many():
    rows = documents()
    rows += [(1000 + i, f"Text {i}" if i % 3 else None, None, "hot", i) for i in range(700)]
    rows += [(2000 + i, "A lone One", "en", f"host{i:03d}", None) for i in range(40)]
    rows += [(3000, "same", "en", "hot", 4)] * 20 + [(3001, f"Tie {i}", "en", "é", 1) for i in range(33)]
    return rows


@pytest.mark.parametrize("sent", [100_000, 0])
def test_manifest_is_that_of_plain_hashing(spark, tmp_path, sent, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_ROWS", sent)
    docs = table(spark, many())
    got = merkle.manifest(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(many())
    if sent:
        assert spark_rows(got) == in_duckdb(spark, tmp_path, QUERIES["op13_merkle_manifest"].sql, documents=docs)


@pytest.mark.parametrize("rows", [[], [documents()[0]], [(None, None, None, None, None)] * 17])
def test_small_manifests(spark, rows):
    got = merkle.manifest(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == (plain_manifest(rows) if rows else [])


def test_a_changed_text_is_found_out(spark):
    got = merkle.manifest(table(spark, many())).collect()
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_no_window_holds_a_whole_group(spark):
    nodes = spark.range(9).selectExpr("string(id) g", "id at", "9L of", "unhex('00') node")
    plan = merkle.parents(nodes)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\d+, run#", plan)
