"""The pipeline against a brute-force version, stage by stage on the stage's own input."""

import corpus_pipeline as P
import public_tokenizers
import tiktoken

from riskspark.llm import bpe
from test_lines import has_word, plain
from test_near_copies import jaccard

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {}
    for i, (name, stage) in enumerate(P.STAGES):
        rows = sorted(docs.collect(), key=lambda r: r.doc_id)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out = docs.collect()
        if name == "quality rules":
            assert {tuple(r) for r in out} <= {tuple(r) for r in rows} and 0 < len(out) < len(rows)
        elif name == "line dedup":
            want = [(d, t) for d, t, n, dropped in plain([(r.doc_id, r.text) for r in rows]) if n == 0 or dropped < n]
            assert key((r.doc_id, r.text) for r in out) == key(want) and all(r.n_chars == len(r.text) for r in out)
        elif name == "SimHash near-dedup":
            stays = {r.doc_id: r.text for r in out}
            gone = [(r.doc_id, r.text) for r in rows if r.doc_id not in stays]
            assert len(stays) == len(out) and {tuple(r) for r in out} <= {tuple(r) for r in rows}
            alike = lambda a, b: min(len(a or ""), len(b or "")) > 0.5 * max(len(a or ""), len(b or "")) and jaccard(a, b)
            kept = sorted(stays.items())
            # the similarity is estimated: no two that stay are well above 0.8, all that go have one well above 0.7
            assert not [(d, e) for i, (d, t) in enumerate(kept) for e, u in kept[:i] if alike(t, u) > 0.85]
            assert all(any(alike(t, r.text) > 0.7 for r in rows if r.doc_id < d) for d, t in gone)
        elif name == "mixing sources":
            assert {tuple(r) for r in out} <= {tuple(r) for r in rows}
            size = lambda some: sum(len(r.text.split()) for r in some)
            assert abs(size(out) - 1.5 * size(rows)) < 0.1 * size(rows)
        else:
            ranks = bpe.Ranks(public_tokenizers.path(P.RANKS)).ids
            known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert key((r.doc_id, r.ids) for r in out) == key((r.doc_id, known.encode_ordinary(r.text)) for r in rows)
        if i < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
        before[name] = len(out)
    again = P.run(spark, SF).select("doc_id", "ids").collect()
    assert key(again) == key((r.doc_id, r.ids) for r in out)
    assert has_word("a")


def through(spark, docs, folder):
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs.collect()


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (None, "", "en", "s", 0), (2, "w" * 50_000, "en", "s", 1)]
    rows += [(i, " ".join(f"the word{i}x{k} of thing{k}" for k in range(60)), "en", "s", 5) for i in range(10, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in through(spark, docs, tmp_path)} <= set(range(10, 14))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert through(spark, docs, tmp_path) == []


def test_columns_of_any_name_stay(spark, tmp_path):
    """Names that the stages use for their own columns."""
    names = ["size", "target", "whole", "part", "source_size", "row", "_row", "n_lines", "n_dropped", "common", "classes", "_chars", "_words", "kept", "_doc", "doc", "id", "keys", "first"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.select(*[f"`{n}`" for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]
