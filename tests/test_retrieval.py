"""Search against brute force, index reuse, pools and lookups."""

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskspark.functions.text import tokens
from riskspark.operators import blocks
from riskspark.operators import retrieval as R
from riskspark.plans import bindings

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "the", "of", "é1", "a"]


def grams(text):
    t = re.findall(r"\w\w+", text.lower())
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


def brute(corpus, queries, k):
    n = len(corpus)
    df = Counter(g for _, text in corpus for g in set(grams(text)))
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in df.items()}

    def vector(text):
        v = {g: (1 + math.log(c)) * idf[g] for g, c in Counter(grams(text)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    docs = [(d, vector(t)) for d, t in corpus]
    out = []
    for q, text in queries:
        v = vector(text)
        sims = [(round(sum(x * w.get(g, 0) for g, x in v.items()), 9), d) for d, w in docs]
        best = sorted((-s, d) for s, d in sims if s > 0)[:k]
        out += [(q, i + 1, d, round(-s, 3)) for i, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    corpus = []
    for i in range(120):
        words = ["the"] + rng.choices(WORDS, weights=[1, 1, 1, 1, 1, 2, 3, 4, 20, 15, 1, 3], k=rng.randint(1, 8))
        corpus.append((f"D{i:03}", " ".join(words)))
    corpus += [(f"E{i:03}", "the of the eta") for i in range(40)]  # copies of one text
    queries = [(i, " ".join(rng.choices(WORDS + ["unknown"], k=rng.randint(1, 6)))) for i in range(60)]
    queries += [(100, "the"), (101, "of the"), (102, ""), (103, "unknown words")] + [(200 + i, "the eta") for i in range(20)]
    return (
        corpus,
        queries,
        spark.createDataFrame(corpus, "icd10 string, description string").repartition(5),
        spark.createDataFrame(queries, "query_id int, query string"),
    )


@pytest.mark.parametrize("k", [1, 5, 200])
@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, data, monkeypatch, small, k):
    """Also with many tasks, blocks of a few documents and queries in many passes."""
    corpus, queries, c, q = data
    if small:
        for name, value in (("TASK_POSTINGS", 150), ("LEAST_PASS", 8), ("LARGEST_PASS", 9), ("PASSES_TOGETHER", 3)):
            monkeypatch.setattr(R, name, value)
        for name, value in (("BLOCK_DOCS", 7), ("BLOCK_POSTINGS", 40), ("CELLS", 30)):
            monkeypatch.setattr(blocks, name, value)
    found = R.search(q, R.build_index(c), k)
    assert sorted(map(tuple, found.collect())) == brute(corpus, queries, k)


def test_weights_by_hand(spark):
    c = spark.createDataFrame([("a", "red red apple"), ("b", "red pear")], "icd10 string, description string")
    index = R.build_index(c)
    terms = {r.term: r for r in index.terms.collect()}
    assert terms["red"].df == 2 and terms["red"].idf == 1.0
    assert abs(terms["apple"].idf - (math.log(3 / 2) + 1)) < 1e-12
    rows = index.blocks.collect()
    weights = {}
    for r in rows:
        for i in range(len(r.terms)):
            for p in range(r.starts[i], r.starts[i + 1]):
                weights.setdefault(r.ids[r.docs[p]], []).append(r.weights[p])
            assert r.tops[i] == max(r.weights[r.starts[i] : r.starts[i + 1]])
    assert set(weights) == {"a", "b"} and all(abs(sum(x * x for x in w) - 1) < 1e-9 for w in weights.values())


def test_a_further_search_reads_no_corpus_and_shuffles_no_block(spark, tmp_path):
    """From stored files: the content is hashed once, blocks are read in place, query texts stay."""
    path = f"{tmp_path}/corpus"
    spark.createDataFrame([(i, f"word{i % 7} text{i} of {i % 3}") for i in range(300)], "icd10 long, description string").write.parquet(path)
    corpus, asked = spark.read.parquet(path), spark.createDataFrame([(1, "word3 text17")], "query_id int, query string")
    R.stored_index(corpus, f"{tmp_path}/index")
    calls = []
    old, R.corpus_fingerprint = R.corpus_fingerprint, lambda *a: calls.append(a)
    try:
        index = R.stored_index(corpus, f"{tmp_path}/index")
    finally:
        R.corpus_fingerprint = old
    found = R.search(asked, index, 3)
    assert [r.doc for r in found.collect() if r.rank == 1] == [17] and not calls
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanges and not any("weights" in e or "query_text" in e for e in exchanges) and "corpus" not in plan
    spark.createDataFrame([(1, "other words")], "icd10 long, description string").write.mode("append").parquet(path)
    assert R.stored_index(spark.read.parquet(path), f"{tmp_path}/index").docs.count() == 301


def test_index_is_reused_until_a_row_changes(spark, tmp_path):
    rows = [("a", "red apple"), ("b", "green pear")]
    frame = lambda r: spark.createDataFrame(r, "icd10 string, description string")
    R.stored_index(frame(rows), str(tmp_path))
    before = {p: p.stat().st_mtime for p in tmp_path.rglob("*.parquet")}
    R.stored_index(frame(rows[::-1]), str(tmp_path))
    assert before == {p: p.stat().st_mtime for p in tmp_path.rglob("*.parquet")}
    changed = R.stored_index(frame([("a", "red apple"), ("b", "green plum")]), str(tmp_path))
    assert {r.term for r in changed.terms.collect()} == {"red", "apple", "green", "plum", "red apple", "green plum"}
    # a folder without its marker is rebuilt
    half = tmp_path / R.corpus_fingerprint(frame([("z", "one two")]), "icd10", "description")
    half.mkdir()
    assert R.stored_index(frame([("z", "one two")]), str(tmp_path)).terms.count() == 3


def test_corpus_and_lookup(spark):
    described = spark.createDataFrame([(" e11.9", "Diabetes", 1), ("E1", "short", 2), ("N18.4", None, 3), ("N185", "Kidney", 4), ("N185", "Kidney again", 5)], "icd10 string, description string, load_order int")
    mapping = spark.createDataFrame([("E119", "19", 1), ("e11.9", "18", 2), ("N185", "bad", 3)], "icd10 string, cc string, load_order int")
    corpus = R.code_corpus(described, mapping)
    assert sorted((r.icd10, r.description, r.cc) for r in corpus.collect()) == [("E119", "Diabetes", "19"), ("N185", "Kidney", ""), ("N185", "Kidney again", "")]
    asked = spark.createDataFrame([("n18.5 ",), ("Q00",)], "code string")
    got = {r.icd10: (r.description, r.cc) for r in R.code_lookup(asked, corpus).collect()}
    assert got == {"N185": ("Kidney again", ""), "Q00": (None, None)}


def test_pool_keeps_the_first_condition(spark):
    c = spark.createDataFrame([("A", "red apple"), ("B", "red pear"), ("C", "green pear")], "icd10 string, description string")
    conditions = spark.createDataFrame([(1, 1, "pear", ""), (1, 2, "x", "red pear"), (2, 1, None, None)], "note_id int, ord int, condition string, search_query string")
    rows = R.candidate_pool(conditions, R.build_index(c)).orderBy("position").collect()
    assert [(r.note_id, r.icd10, r.ord, r.position) for r in rows] == [(1, "B", 1, 1), (1, "C", 1, 2), (1, "A", 2, 3)]
    assert rows[0].for_condition == "pear" and all(0 < r.similarity <= 1 for r in rows)


def test_anchors_are_the_marked_runs_of_each_length(spark):
    texts = ["aa bb cc dd aa bb cc", "cc", "", None, "bb cc", "zz aa bb dd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    run = lambda t: docs.sparkSession.sql(f"SELECT xxhash64(transform(array({t}), x -> xxhash64(x))) AS a, xxhash64({t.split(',')[0]}) AS f").first()
    first, marks, wanted = bytearray(bindings.ANCHOR_PLACES), bytearray(bindings.ANCHOR_PLACES), {}
    for n, t in ((2, "'aa','bb'"), (3, "'bb','cc','dd'"), (1, "'cc'")):
        r = run(t)
        first[r.f % bindings.ANCHOR_PLACES] = marks[r.a % bindings.ANCHOR_PLACES] = 1
        wanted[n] = r.a
    found = docs.select("doc", F.explode(bindings.anchors_in(tokens("text"), bytes(first), bytes(marks), [1, 2, 3])).alias("a")).select("doc", "a.*")
    assert sorted(map(tuple, found.collect())) == sorted(
        [(0, 1, wanted[1]), (0, 2, wanted[2]), (0, 3, wanted[3]), (1, 1, wanted[1]), (4, 1, wanted[1]), (5, 2, wanted[2])]
    )


def test_an_index_of_many_chunks_moves_texts_and_no_postings(spark, data, monkeypatch, tmp_path):
    """Frequencies and largest weights over chunks; only parts that are asked for are written."""
    monkeypatch.setattr(R, "TASK_POSTINGS", 150)
    corpus, _, c, _ = data
    df, texts, top = Counter(), {}, {}
    for d, text in corpus:
        df.update(set(grams(text)))
        texts[text] = d
    n_postings = Counter(g for text in texts for g in set(grams(text)))
    for text in texts:
        v = {g: (1 + math.log(n)) * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, n in Counter(grams(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for g, x in v.items():
            top[g] = max(top.get(g, 0), x / norm)
    index = R.build_index(c)
    found = {r.term: (r.df, r.n_postings, round(r.max_weight, 9)) for r in index.terms.collect()}
    assert found == {g: (df[g], n_postings[g], round(top[g], 9)) for g in df}
    assert {(r.h, r.df) for r in index.frequencies.collect()} == {(r.h, r.df) for r in index.terms.collect()}
    plan = index.blocks._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert moved and not any("weights" in e or "tf" in e for e in moved)
    R.stored_index(c, str(tmp_path), parts=("frequencies", "blocks", "docs"))
    assert {p.name for p in tmp_path.glob("*/*")} == {"complete", "size", "frequency", "blocks", "docs"}


def test_a_pool_is_one_shuffle_by_note_and_few_hits_go_to_the_conditions(spark, data):
    """One query of very many rows meets in no task, and the rows are never broadcast."""
    _, _, c, _ = data
    conditions = spark.range(20_000).selectExpr("id AS note_id", "1 AS ord", "'the eta' AS condition", "'' AS search_query")
    pool = R.candidate_pool(conditions, R.build_index(c))
    assert pool.groupBy("note_id").count().where("count != 6").count() == 0
    pool.collect()
    plan = pool._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    by_note = [line for line in plan.split("\n") if " Exchange hashpartitioning(note_id" in line or "- Exchange hashpartitioning(note_id" in line]
    assert len(by_note) == 1 and "SortAggregate" not in plan.split(by_note[0])[0]
    assert R.SENT_HITS and "BroadcastHashJoin" in plan and "BuildRight" in plan


@pytest.mark.parametrize("listed, bits", [(1_000, 17), (0, 17), (0, 5), (0, 1)])
def test_queries_leave_their_rows_as_known_terms_and_are_searched_once(spark, data, monkeypatch, listed, bits):
    """Long texts that share the terms of the index are one query; marks that sort out little, or nothing, change no result."""
    monkeypatch.setattr(R, "LISTED_TERMS", listed)
    monkeypatch.setattr(R, "MARK_BITS", bits)
    corpus, _, c, _ = data
    rows = [(i, f"junk{i} the eta more{i % 7} eta") for i in range(50)] + [(98, "none of these"), (99, None), (100, "aa bb"), (101, "")]
    searched = []
    best_texts = R.best_texts
    monkeypatch.setattr(R, "best_texts", lambda vectors, *more: searched.append(vectors.count()) or best_texts(vectors, *more))
    found = R.search(spark.createDataFrame(rows, "query_id int, query string"), R.build_index(c), 3)
    assert sorted(map(tuple, found.collect())) == brute(corpus, [r for r in rows if r[1]], 3)
    assert bits < 17 or searched == [2]


def test_an_index_is_built_and_searched_in_small_pieces(spark, data, monkeypatch, tmp_path):
    """A chunk is weighed and packed by one Python worker, stored in small row groups and searched block after block, of which few are sent at a time."""
    corpus, queries, c, q = data
    assert R.build_index(spark.createDataFrame([("a", "word " * 400_000)], "icd10 string, description string"))._chunks > 1
    for name, value in (("TASK_POSTINGS", 150), ("GROUP_BYTES", 1_000), ("GROUP_ROWS", 1), ("CHUNKS_OF_TASK", 100)):
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 3)
    index = R.build_index(c)
    plan = index.blocks._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan and "lead" not in plan
    assert max(len(r.ids) for r in index.blocks.collect()) == 3
    stored = R.stored_index(c, str(tmp_path))
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("*/blocks/*.parquet")]
    assert files and any(f.num_row_groups > 1 for f in files)
    before = spark.conf.get(R.BATCH_KEY)
    try:
        found = R.search(q, stored, 5)
        assert sorted(map(tuple, found.collect())) == brute(corpus, queries, 5)
        assert R._bytes(spark.conf.get(R.BATCH_KEY)) <= 8 << 20
    finally:
        spark.conf.set(R.BATCH_KEY, before)
    assert [R._bytes(x) for x in ("67108864b", "64m", "8k", "-1b", "1g")] == [64 << 20, 64 << 20, 8192, 0, 0]


def test_marks_are_gathered_as_words_of_bits(spark, data):
    """What the driver collects doesn't grow with the number of tasks, and terms are read without the chunks' answers."""
    index = R.build_index(data[2])
    marks, wanted = index.marks(), set()
    for r in index.frequencies.collect():
        wanted |= {((r.h >> (R.MARK_BITS * i)) & ((1 << R.MARK_BITS) - 1)) + (i << R.MARK_BITS) for i in range(R.MARK_STRETCHES)}
    assert len(marks) == R.MARK_STRETCHES << R.MARK_BITS and set(marks.nonzero()[0].tolist()) == wanted
    assert all(not r.df for r in index._frequency.where("chunk < 0").collect()) and all(not r.total for r in index._frequency.where("chunk >= 0").collect())


def test_keys_of_any_length_are_kept_in_order_over_blocks(spark, monkeypatch):
    """Longer keys in later blocks aren't cut, and ties go to the smaller key."""
    rows = [(f"{'k' * (1 + i % 9)}{i:03}", "same words" + " x" * (i % 3) + f" own{i}") for i in range(60)]
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 2)
    c = spark.createDataFrame(rows, "icd10 string, description string").coalesce(1)
    q = spark.createDataFrame([(1, "same words"), (2, "own7")], "query_id int, query string")
    assert sorted(map(tuple, R.search(q, R.build_index(c), 7).collect())) == brute(rows, [(1, "same words"), (2, "own7")], 7)
