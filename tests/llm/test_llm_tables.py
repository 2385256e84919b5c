"""Language, lines, host rules, near duplicates and top-k against brute force and SQL."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import rows_of, spark_rows
from llm_fixtures import SCHEMA, documents, near_components, prose, table, words_of
from panewise.llm import host_rules, line_chunks, near_join, sql, topk, word_lang
from panewise.llm.common import Scratch
from panewise.llm.components import components
from panewise.llm.registry import QUERIES
from panewise.llm.shingles import shingle_sets, word_hashes


def in_duckdb(spark, tmp_path, statement, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        path = str(tmp_path / name)
        rows.write.parquet(path)
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    cursor = con.execute(statement)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


# Language -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_marginals_are_those_of_all_labellings(n):
    rng = np.random.default_rng(n)
    k, opens = 3, np.zeros(n, bool)
    opens[0] = True
    opens[n // 2] = True
    score, change, first = rng.normal(size=(n, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
    one, pair, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(score[i, y[i]] + (first[y[i]] if opens[i] else change[y[i - 1], y[i]]) for i in range(n)))
        total += w
        for i in range(n):
            one[i, y[i]] += w
            if not opens[i]:
                pair[y[i - 1], y[i]] += w
    got = word_lang.marginals(score, opens, change, first)
    assert np.allclose(got, one / total)
    assert np.allclose(word_lang.expected_changes(score, opens, change, first, got), pair / total)


@pytest.fixture(scope="module")
def model():
    return word_lang.train([(r[1], r[2]) for r in documents() if r[2] and r[1]][:80])


def test_words_of_switched_text(spark, model):
    assert model.languages == ["en", "fr"]
    text = "the other would about there from " * 3 + "avec cette leur après pour dans " * 3
    (got,) = word_lang.identify(table(spark, [(1, text, None, None, None)]), model, runs=True).collect()
    assert [(r.first, r.n, r.lang) for r in got.runs] == [(0, 18, "en"), (18, 18, "fr")] and got.n_runs == 2


def test_a_cut_text_gives_the_same_chances(spark, model, monkeypatch):
    docs = table(spark).filter("doc_id <> 105")  # a word longer than a part is cut
    whole = word_lang.identify(docs, model).collect()
    monkeypatch.setattr(word_lang, "_AT_ONCE", 1000)
    cut = word_lang.identify(docs, model).collect()
    key = lambda r: (str(r.doc_id), r.n_words, r.lang_pred)
    for a, b in zip(sorted(whole, key=key), sorted(cut, key=key)):
        assert key(a) == key(b) and a.score == pytest.approx(b.score, abs=1e-6)


def test_texts_that_are_labelled_together_are_few(model, monkeypatch):
    import pyarrow as pa

    seen, of = [], word_lang.Words.of
    monkeypatch.setattr(word_lang.Words, "of", lambda texts, letter: (seen.append(sum(map(len, texts))), of(texts, letter))[1])
    texts = ["the other would about there from " * 100] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["id", "text"])
    assert sum(b.num_rows for b in word_lang._label(model, False)(iter([batch]))) == 300
    assert max(seen) <= 1 << 18 and sum(seen) == sum(map(len, texts))


def test_languages_of_a_table(spark):
    docs = table(spark)
    taught = word_lang.stretches(docs, rows=30)
    assert {g for _, g in taught} == {"en", "fr"} and sum(g == "en" for _, g in taught) <= 30
    got = word_lang.identify(docs, word_lang.train(taught)).collect()
    lang = {r[0]: r[2] for r in documents()}
    assert len(got) == len(documents())
    sure = [r for r in got if r.doc_id is not None and r.doc_id < 95]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in sure]) > 0.95
    for r in got:
        text = dict((x[0], x[1]) for x in documents() if x[0] is not None).get(r.doc_id, "a")
        none = not any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == none or r.doc_id is None
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und")
    nothing = word_lang.identify(docs, word_lang.train([])).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]
    assert word_lang.stretches(docs.limit(0)) == []
    assert word_lang.identify(docs.limit(0), word_lang.train(taught)).count() == 0


def test_held_out_documents_of_the_driver_tables(spark, sf_medium):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    got = QUERIES["op1_crf_language"].run(spark, sf_medium).join(docs.select("doc_id", "lang"), "doc_id")
    right, held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 and held > 100
    assert got.filter("held_out").select("doc_id").collect()[0][0] is not None
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got.collect())


# Lines ----------------------------------------------------------------------------------------------


def odd_documents(spark, extra=False):
    """Documents whose ids tell them apart, as the SQL has no other name for a row."""
    rows = {r[0]: r for r in documents() if r[0] is not None}
    return table(spark, list(rows.values()), extra)


def test_lines_are_those_of_the_sql(spark, tmp_path):
    docs = odd_documents(spark, extra=True)
    got = line_chunks.dedup(docs, told="told").select("doc_id", "text", "told.n_lines", "told.n_removed")
    assert spark_rows(got) == in_duckdb(spark, tmp_path, sql.LINE_CHUNKS, documents=docs)


def test_a_shared_passage_goes_wherever_it_stands(spark):
    docs = table(spark)
    got = line_chunks.dedup(docs, told="told")
    assert got.columns == [*docs.columns, "told"]
    rows = {r[0]: r[1] for r in documents()}
    texts = {r["doc_id"]: r["text"] for r in got.select("doc_id", "text").collect()}
    block = rows[60].split("\n")[1:-1]
    assert texts[60] == rows[60] and texts[97] is None and texts[98] == ""
    for i in range(61, 66):
        left = sum(line in texts[i].split("\n") for line in block)
        assert left <= 5 and texts[i].split("\n")[0] == rows[i].split("\n")[0] and texts[i].split("\n")[-1] == rows[i].split("\n")[-1]
    assert texts[3] == rows[3] and all(len(texts[90 + i]) < len(rows[3]) for i in range(5))
    clean = [i for i in range(60) if i != 3 and texts[i] != rows[i]]
    assert clean == []
    assert got.count() == len(documents())
    assert line_chunks.dedup(docs.limit(0)).count() == 0


def plain_whole(rows):
    """Texts without the lines of repeated pairs and long lines, by place in the order of ids, then lines."""
    at, lines = {}, {}
    for k, (i, text) in enumerate(rows):
        lines[k] = (text or "").split("\n")
        full = [j for j, line in enumerate(lines[k]) if re.search(r"[^\x20\x09-\x0D]", line)]
        stretches = list(zip(full, full[1:])) + [(j, j) for j in full if len(words_of(lines[k][j])) > 50]
        for a, b in stretches if text else []:
            at.setdefault("\n".join(lines[k][a : b + 1]), []).append(((2**63 if i is None else i, a), k, b))
    gone = {k: set() for k in lines}
    for places in at.values():
        for place, k, b in places:
            if place > min(places)[0]:
                gone[k].update(range(place[1], b + 1))
    return [(i, None if t is None else "\n".join(x for j, x in enumerate(lines[k]) if j not in gone[k])) for k, (i, t) in enumerate(rows)]


def test_whole_passages_go_to_their_last_line(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    new = lambda n=12: prose(rng, vocabulary, n)
    long, rows = new(70), [r[:2] for r in documents()]
    for n in (1, 2, 3, 4, 5, 8, 30):
        passage = "\n".join(new(60) if n == 1 else new() for _ in range(n))
        for _ in range(3):
            rows.append((len(rows) + 1000, f"{new()}\n{new()}\n{passage}\n{new()}\n{new()}"))
    rows += [(2000, long), (2001, long), (2002, f"{new()}\n{long}"), (2003, "a b\n\n \nc d\nx"), (2004, "y\na b\n\n \nc d\n"), (2005, "a b\n\nc d\nz")]
    docs = table(spark, [(i, t, None, None, None) for i, t in rows])
    got = line_chunks.dedup(docs, told="told")
    assert got.columns == [*docs.columns, "told"]
    found = got.select("doc_id", "text", "told").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(plain_whole(rows), key=repr)
    texts = {r.doc_id: r for r in found}
    assert all(texts[i].text.count("\n") == 3 for i, t in rows if 1000 <= (i or 0) < 2000 and texts[i].text != t)
    assert sum(texts[i].text != t for i, t in rows if 1000 <= (i or 0) < 2000) == 14
    assert texts[2001].text == "" and texts[2002].told.n_removed == 1 and texts[2004].text == "y\n" and texts[2005].told.n_removed == 0
    assert line_chunks.dedup(docs.limit(0)).count() == 0


# Host rules -----------------------------------------------------------------------------------------


def test_host_rules_are_those_of_the_sql(spark, tmp_path):
    docs = table(spark)
    got = host_rules.judge(docs)
    assert spark_rows(got) == in_duckdb(spark, tmp_path, sql.HOST_RULES, documents=docs.drop("id"))


def test_repeated_words_by_hand(spark):
    texts = {"a b c a b c": 6, "a b c d a b c": 6, "a a a a": 4, "a b": 0, "": 0, "a b c d e f": 0, "x a b c y a b c": 6}
    docs = spark.createDataFrame([(i, t, None, "h", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r.n_repeat_words for r in host_rules.measured(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_hosts_are_drawn_to_the_common_rate(spark):
    good, bad = "w1 w2 w3 w4 w5 w6 w7 w8 w9 ".replace("w", "word") + prose(random.Random(1), [f"a{i}" for i in range(500)], 80), "short text"
    rows = [("big", good)] * 60 + [("spam", bad)] * 50 + [("spam", good)] * 10 + [("tiny", bad), ("tiny", good)] + [(None, good)] * 3
    docs = spark.createDataFrame([(i, t, None, h, 0) for i, (h, t) in enumerate(rows)], SCHEMA)
    kept = {}
    for r in host_rules.judge(docs).collect():
        kept.setdefault(rows[r.doc_id][0], []).append(r.kept)
    assert all(kept["big"]) and not any(kept["spam"]) and kept["tiny"] == [False, True] and all(kept[None])
    assert host_rules.judge(docs.limit(0)).count() == 0


def test_a_host_that_stands_out_is_told_from_the_others(spark, tmp_path):
    """A host of which a third fail one rule or another, none of them half of its documents: only the verdict on the
    host takes its other documents out."""
    r = random.Random(9)
    words = [f"a{i}" for i in range(900)]
    good = lambda: prose(r, words, 70)
    failing = [lambda: "too short", lambda: good() + " #" * 80, lambda: "\n".join([good()] + ["the same line of words"] * 9)]
    rows = [(f"h{h}", failing[i % 3]() if i % 14 == 0 else good()) for h in range(25) for i in range(60)]
    rows += [("odd", failing[i // 3 % 3]() if i % 3 == 0 else good()) for i in range(150)]
    docs = spark.createDataFrame([(i, t, None, h, 0) for i, (h, t) in enumerate(rows)], SCHEMA)
    got = host_rules.judge(docs)
    lost = {rows[x.doc_id][0] for x in got.collect() if not x.kept and not x.base_failed}
    assert lost == {"odd"} and got.filter("kept").count() > 1300
    assert spark_rows(got) == in_duckdb(spark, tmp_path, sql.HOST_RULES, documents=docs)


# Near duplicates ------------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    words = [w.encode() for w in words_of(" ".join(r[1] or "" for r in documents()))]
    got, place = word_hashes(b" \n".join(words))
    assert len(got) == len(words)
    low = {w.lower() for w in words}
    assert len(set(got.tolist())) == len({re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in words}) <= len(low) + 5
    long = b" ".join(words * 40)
    assert (word_hashes(long)[0] == np.tile(got, 40)).all()


def test_words_of_a_known_form_have_their_own_hashes():
    """Words in Thue-Morse order, for which sums of powers modulo 2^64 are equal, and all short ones."""

    def order(n, a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(n))

    for n in (512, 1024, 2048, 8192):
        hashes, _ = word_hashes(f"{order(n, 'a', 'b')} {order(n, 'b', 'a')}".encode())
        assert hashes[0] != hashes[1]
        sets = [shingles_of(f"x {order(n, *p)} y z".encode()) for p in ("ab", "ba")]
        assert set(sets[0]).isdisjoint(sets[1])
    every = ["".join(p) for n in range(1, 5) for p in itertools.product("abcdefg", repeat=n)]
    every += [w + "12345678" * k + "x" * (k % 9) for k in range(70) for w in every[:20]]
    hashes, place = word_hashes(" ".join(every).encode())
    assert len(hashes) == len(every) and len(set(hashes.tolist())) == len(set(every))
    again, _ = word_hashes(" \n".join(w.upper() for w in every).encode())
    assert (again == hashes).all()


def shingles_of(text):
    return shingle_sets([text], 3)[0].tolist()


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_near_duplicates_are_those_of_all_pairs(spark, size, num, den, monkeypatch):
    if size == 2:  # many parts and blocks
        monkeypatch.setattr(near_join, "MEMBER_TOKENS", 300)
        monkeypatch.setattr(near_join, "QUERY_TOKENS", 500)
    rows = documents()
    found = near_components([r[1] for r in rows], size, num, den)
    groups = {}
    for i, (n, label) in enumerate(found):
        groups.setdefault(label, []).append(rows[i][0])
    want = []
    for r, (n, label) in zip(rows, found):
        ids = [i for i in groups[label] if i is not None]
        want.append((r[0], n, (min(ids) if ids else None) if n else r[0]))
    got = near_join.join(table(spark), size, num, den).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    if size == 5:
        first = near_join.first_of_each(table(spark), size, num, den)
        assert first.columns == table(spark).columns
        stay = [r for r, w in zip(rows, want) if r[0] is None or r[0] == w[2]]
        assert sorted((tuple(r)[:2] for r in first.collect()), key=repr) == sorted((r[:2] for r in stay), key=repr)


def test_empty_near_join(spark):
    assert near_join.join(table(spark).limit(0)).count() == 0
    assert near_join.join(table(spark, [(1, None, None, None, None)])).collect() == [(1, 0, 1)]


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (1, 2), (1, 40)])
def test_no_link_is_lost_by_ranges_of_hashes(num, den):
    """Sets of all sizes, copies with other shingles, and sets with many shingles in one range."""
    rng, threshold = np.random.default_rng(num), near_join.Threshold(num, den)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 7, 60, 500, 520, 600, 1100, 9000)]
    sets += [rng.integers(0, 1 << 40, n, np.uint64) for n in (300, 700, 720)]
    for s in list(sets):
        for share in (0.04, 0.1, 0.4):
            new = rng.integers(0, 1 << 64, max(1, int(share * len(s))), np.uint64)
            sets += [np.r_[s[len(new) :], new], np.r_[s, new]]
    sets = [np.unique(s) for s in sets]

    def side(of):
        n = pa.array([len(sets[c]) for c in of], pa.int64())
        sigs = pa.array([near_join._ranges(sets[c]) for c in of], pa.binary())
        return pa.table({"g": pa.array([5] * len(of), pa.int64()), "c": pa.array(of, pa.int64()), "n": n, "sig": sigs})

    def linked(a, b):
        return a != b and len(np.intersect1d(sets[a], sets[b])) >= threshold.overlap(len(sets[a]), len(sets[b]))

    queries, members = list(range(0, len(sets), 2)), list(range(len(sets)))
    left = near_join._sift(threshold)(side(queries), side(members)).to_pylist()
    asks, held = ({r["c"] for r in left if r["asks"] == k} for k in (True, False))
    assert asks >= {a for a in queries if any(linked(a, b) for b in members)}
    assert held >= {b for b in members if any(linked(a, b) for a in queries)}
    pairs = [(a, b) for a in queries for b in members]
    of_a, of_b = side([a for a, _ in pairs]), side([b for _, b in pairs])
    met = pa.table({"c": of_a["c"], "g": of_b["c"], "n": of_a["n"], "m": of_b["n"], "sig": of_a["sig"], "of_g": of_b["sig"]})
    close = {(r["c"], r["g"]) for b in near_join._close(threshold)(iter(met.to_batches())) for r in b.to_pylist()}
    assert close >= {p for p in pairs if linked(*p)}
    if num > 2:  # and sets that have nothing in common go
        apart = near_join._sift(threshold)(side([4]), side([5, 6, 3]))
        assert apart.num_rows == 0 and not close & {(4, 5), (4, 6)}


def test_groups_are_not_opened_for_texts_that_share_a_shingle(spark, monkeypatch):
    """Texts of many sizes that have shingles in common, but too few of them: no shingle of theirs is sent."""
    opened, open_groups = [], near_join._opened
    monkeypatch.setattr(near_join, "_opened", lambda pairs, *rest: opened.append(pairs.count()) or open_groups(pairs, *rest))
    monkeypatch.setattr(near_join, "ROUND_TOKENS", 50)
    rng = random.Random(8)
    shared = [" ".join(rng.choice("abcdefgh") * 4 + str(rng.randrange(300)) for _ in range(5)) for _ in range(12)]
    texts = [" ".join([*rng.sample(shared, 3), *(f"w{i}x{k}" for k in range(75 + i % 4))]) for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[7] + " end", texts[9]])]
    got = near_join.join(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(60)} | {60: 7, 61: 9}
    assert sum(opened) <= 2


def test_scratch_leaves_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in str(manager.getAllFiles().mkString(" ")).split() if "/shuffle_" in f}

    scratch, before = Scratch(spark, "test"), files()
    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    table = scratch.write(rows.filter("k < 4"), rows.filter("k >= 4"))
    assert sorted(map(tuple, table.collect())) == [(k, 100) for k in range(10)]
    assert not files() - before


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in list(parent) if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Top k ----------------------------------------------------------------------------------------------


def best(rows, k):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % 50 == 0:
            most = (1 << 63) - 1  # scores of more bits count as this
            scored = sorted((max(-most, min(most, -sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"pivots": 3, "rings": 2, "sample": 20}])
def test_top_k(spark, bounds, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_GROUP", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 560)]  # one common vector
    rows += [(600, None), (650, [float("nan")] + [1.0] * 7), (700, [None] + [1.0] * 7), (None, [1.0] * 8), (750, []), (800, [float("inf")] * 8)]
    rows += [(850, [2.0**20] + [1.0] * 7), (900, [2.0**45, -(2.0**44)] + [0.25] * 6), (901, [1.0, 3.0])]  # wide and short ones
    rows += [(850, [2.0**20] + [1.0] * 7), rows[50], rows[401], (950, [0.5] * 8), (950, [0.5] * 8)]  # repeated rows
    docs = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string, cell int")
    got = topk.search(docs, docs.filter("vec_id % 50 = 0"), 5, **bounds)
    assert sorted(map(tuple, got.collect())) == best(rows, 5)
    few = docs.filter("vec_id in (0, 1, 50)")
    assert sorted(map(tuple, topk.search(few, few.filter("vec_id % 50 = 0"), 5).collect())) == best(rows[:2] + [rows[50]] * 2, 5)
    assert topk.search(docs.limit(0), docs.limit(0), 5).count() == 0


def test_the_own_row_takes_no_place_among_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.search(docs, docs.filter("vec_id % 50 = 0"), 5, pivots=1, rings=1)  # all rows in one group
    assert sorted(map(tuple, got.collect())) == best(rows, 5)


def test_products_are_exact():
    q, x = np.full((2, 3), 2.0**27), np.full((1, 3), 2.0**27 - 1)
    assert topk.products(q, x).tolist() == [[3 * 2**27 * (2**27 - 1)]] * 2
    mixed = np.array([[1.0, 2.0, 3.0], [2.0**40, 1.0, 1.0], [2.0**90, 0.0, 0.0], [-(2.0**90), 0.0, 0.0]])
    got = topk.products(np.array([[2.0**20, 1.0, 1.0]]), mixed)
    assert got.tolist() == [[2**20 + 5, 2**60 + 2, 2**63 - 1, 1 - 2**63]]
