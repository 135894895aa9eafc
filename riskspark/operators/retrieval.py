"""TF-IDF index over a corpus and exact top-k cosine search for many queries at once.

Identical texts are indexed once: a corpus row points to ``text_id``, the smallest
document key among its copies, and counts of copies keep document frequencies right.
Queries with the same terms of the index are searched once, whatever else their texts hold.

The index is stored in blocks of documents (:mod:`blocks`), each with its terms' postings and
largest weights. A search reads the blocks where they lie: queries go to them in passes of
bounded size, a block is passed over by all queries whose k-th score it cannot reach, and
of each task only k rows for each query are shuffled. That is exact at every size.

Terms are known by a hash of 64 bits; texts of documents and queries travel no further than to their terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.text import ngrams, tokens
from riskspark.operators import blocks, chunks
from riskspark.operators.blocks import best_of_pass
from riskspark.session import keeper
from riskspark.sources import fixed_values as fv

#: Postings of a chunk of texts, which a Python worker counts and weighs at a time, about, and characters a posting, at least.
TASK_POSTINGS, CHARS_OF_POSTING = 500_000, 3
#: Chunks of a task, one after the other, and of a bucket of hashes, about.
CHUNKS_OF_TASK, CHUNKS_OF_BUCKET = 8, 4
#: Bytes of the blocks that a Python worker gets at a time, about; Spark holds twice as many beside its heap.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Layout of the stored parts; an index of another one is built anew.
LAYOUT = 2
#: Bytes of a row group of a stored part, about, and rows between looks at its size: a block has some MB.
GROUP_BYTES, GROUP_ROWS = 32 << 20, 4
#: Terms of an index that queries' terms are compared with as they are; more are known by marks. A term has a place in each of some stretches of bytes, by as many bits of its hash.
LISTED_TERMS, MARK_BITS, MARK_STRETCHES = 1_000, 17, 3
#: Terms of the queries of one pass, at least and at most: 16 bytes each in every task.
LEAST_PASS, LARGEST_PASS = 1 << 14, 1 << 20
#: Passes that run in one job, before their results are written.
PASSES_TOGETHER = 16
#: Hits that are sent to where the queries lie; with more of them both sides are shuffled.
SENT_HITS = 200_000


class TfidfIndex:
    """terms(term, h, df, idf, n_postings, max_weight), blocks (see :mod:`blocks`), frequencies(h, df, idf),
    docs(doc, text_id, copy): copies of a text are numbered in the order of their keys.

    ``part(name, make)`` gives one part; it may write it and read it back. A part is built when it is first asked for.
    """

    def __init__(
        self, corpus: DataFrame, doc: str, text: str, part: Callable[[str, Callable[[], DataFrame]], DataFrame], keep_rows: bool = False
    ) -> None:
        self._corpus, self._doc, self._text, self._part, self._keep_rows = corpus, doc, text, part, keep_rows

    @cached_property
    def _rows(self) -> DataFrame:
        rows = self._corpus.selectExpr(f"{self._doc} AS doc", f"{self._text} AS text", f"unhex(sha2({self._text}, 256)) AS text_hash")
        return self._part("rows", lambda: rows) if self._keep_rows else rows

    @cached_property
    def _size(self) -> tuple[int, int]:
        """Rows and characters of the corpus."""
        sums = self._part("size", lambda: self._rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))
        return tuple(sums.first())

    @property
    def _chunks(self) -> int:
        return 1 + self._size[1] // (CHARS_OF_POSTING * TASK_POSTINGS)

    @property
    def _bits(self) -> int:
        return ((self._chunks - 1) // CHUNKS_OF_BUCKET).bit_length()

    @property
    def _tasks(self) -> int:
        return max(-(-self._chunks // CHUNKS_OF_TASK), min(self._chunks, self._corpus.sparkSession.sparkContext.defaultParallelism))

    def _texts(self, *more: str) -> DataFrame:
        """(chunk, text_id, copies, t): distinct texts, dealt out by chunk, with the hashes of their terms."""
        # Copies collapse on the map side first, so a text held by a third of all rows sends
        # one row per task. The texts are cut where they land.
        texts = self._rows.where("text IS NOT NULL").groupBy("text_hash").agg(
            F.min("doc").alias("text_id"), F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")
        )
        dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("text_hash"), F.lit(self._chunks)).cast("int")).drop("text_hash").repartition(self._tasks, "chunk")
        return dealt.selectExpr("chunk", "text_id", "copies", f"{ngrams('text')} AS g").selectExpr("chunk", "text_id", "copies", "transform(g, x -> xxhash64(x)) AS t", *more)

    @cached_property
    def _frequency(self) -> DataFrame:
        return self._part("frequency", lambda: chunks.frequency(self._texts(), self._bits))

    @property
    def _answers(self) -> DataFrame:
        return self._frequency.where("chunk >= 0")

    def _idf(self) -> Column:
        return F.log((1 + self._size[0]) / (1 + F.col("df"))) + 1

    @cached_property
    def frequencies(self) -> DataFrame:
        rows = self._totals.select(F.explode(F.arrays_zip("h", "total")).alias("p"))
        return rows.select("p.h", F.col("p.total").alias("df")).withColumn("idf", self._idf())

    @property
    def _totals(self) -> DataFrame:
        return self._frequency.where("chunk < 0").select("h", "total")

    def marks(self) -> np.ndarray:
        """A byte for each place that a term of the index has. Tasks send words of bits, so what is collected is bounded."""
        bits, n, step = MARK_STRETCHES << MARK_BITS, MARK_STRETCHES, MARK_BITS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.zeros(-(-bits // 64) * 64, np.uint8)
            for batch in batches:
                h = batch.column("h").flatten().to_numpy()
                for i in range(n):
                    marks[((h >> (step * i)) & ((1 << step) - 1)) + (i << step)] = 1
            words = np.packbits(marks, bitorder="little").view("<i8")
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["word", "bits"])

        found = self._totals.select("h").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
        words = np.zeros(-(-bits // 64), "<i8")
        words[[r.word for r in found]] = [r.bits for r in found]
        return np.unpackbits(words.view(np.uint8), bitorder="little")[:bits]

    @cached_property
    def blocks(self) -> DataFrame:
        return self._part("blocks", lambda: chunks.packed(self._texts(), self._answers, self._size[0], blocks.BLOCK_DOCS, blocks.BLOCK_POSTINGS))

    @cached_property
    def terms(self) -> DataFrame:
        found = self._part("terms", lambda: chunks.terms(self._texts("g"), self._answers, self._size[0], self._bits))
        return found.select("term", "h", "df", self._idf().alias("idf"), "n_postings", "max_weight")

    @cached_property
    def docs(self) -> DataFrame:
        def make() -> DataFrame:
            pointers = self._rows.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.min("doc").alias("text_id"))
            copies = Window.partitionBy("text_id").orderBy("doc")
            return self._rows.select("doc", "text_hash").join(pointers, "text_hash").select("doc", "text_id", F.row_number().over(copies).alias("copy"))

        return self._part("docs", make)


def _vectors(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, terms, weights) of rows (keys…, h, raw): terms in order, weights of length one."""
    grouped = weighted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "raw"))).alias("pairs"))
    norm = F.sqrt(F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
    # bound to a lambda variable, so that it is computed once for an array
    weights = F.get(F.transform(F.array(norm), lambda n: F.transform("pairs", lambda x: x["raw"] / n)), F.lit(0))
    return grouped.select(*keys, F.col("pairs.h").alias("terms"), weights.alias("weights"))


def build_index(corpus: DataFrame, doc: str = "icd10", text: str = "description", keep=lambda df, name: df) -> TfidfIndex:
    """The index of a corpus. ``keep(df, name)`` may write a part and read it back, so
    that it isn't computed again."""
    return TfidfIndex(corpus, doc, text, lambda name, make: keep(make(), name))


def corpus_fingerprint(corpus: DataFrame, doc: str, text: str) -> str:
    """Changes when any row changes, not only when the row count does."""
    row = corpus.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(doc, text).cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(text, doc, F.lit(1)).cast("decimal(38,0)")).alias("h2"),
    ).first()
    return f"{row.n}_{row.h1}_{row.h2}".replace("-", "m")


def source_version(corpus: DataFrame, doc: str, text: str) -> str | None:
    """Names, sizes and times of the files that a corpus is read from, with its plan; None without files."""
    files = corpus.inputFiles()
    if not files:
        return None
    path = corpus.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = corpus.sparkSession.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(files):
        status = path(f).getFileSystem(conf).getFileStatus(path(f))
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([doc, text, str(corpus.schema), str(corpus.semanticHash()), *seen]).encode()).hexdigest()


def _there(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def stored_index(
    corpus: DataFrame,
    path: str,
    doc: str = "icd10",
    text: str = "description",
    parts: tuple[str, ...] = ("frequencies", "blocks", "docs", "terms"),
    keep_rows: bool = False,
) -> TfidfIndex:
    """The index kept under ``path`` for exactly this corpus; ``parts`` are built where they are missing,
    others when they are first used. ``keep_rows`` writes the corpus as well, where it is the result of a
    longer plan, so that its parts don't compute it again.

    Each content has its own folder, and each part a marker written last, so a build that was cut
    short is never taken for a finished one. The content is hashed once for each version of
    the source files; as long as they stand, a further search reads nothing of the corpus.
    """
    spark, root = corpus.sparkSession, path.rstrip("/")
    version = source_version(corpus, doc, text)
    known = _there(spark, f"{root}/versions/{version}") if version else None
    content = known.first().content if known is not None else corpus_fingerprint(corpus, doc, text)
    folder = f"{root}/{content}_{LAYOUT}"

    def part(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if _there(spark, f"{folder}/complete/{name}") is None:
            bounds = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": GROUP_ROWS}
            make().write.mode("overwrite").options(compression="zstd", **bounds).parquet(f"{folder}/{name}")
            spark.range(1).write.mode("overwrite").parquet(f"{folder}/complete/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    index = TfidfIndex(corpus, doc, text, part, keep_rows)
    for name in parts:
        getattr(index, name)
    if version and known is None:
        spark.createDataFrame([(content,)], "content string").write.mode("overwrite").parquet(f"{root}/versions/{version}")
    return index


def _places(h: Column) -> list[Column]:
    return [(F.pmod(F.shiftright(h, MARK_BITS * i), F.lit(1 << MARK_BITS)) + (i << MARK_BITS)).cast("int") for i in range(MARK_STRETCHES)]


def known_terms(text: str, index: TfidfIndex) -> Column:
    """Hashes of the terms of a text (a column) that the index may hold, each as often as it occurs, in order.

    A list or marks, both of bounded size, sort the others out inside the row, so a long text leaves it as the few terms that count. A bigram of
    the index starts with a term of it. Few terms pass that the index doesn't hold; with so many terms that
    the marks say nothing all of them pass.
    """
    listed = [r.h for r in index.frequencies.select("h").limit(LISTED_TERMS + 1).collect()]
    marks = np.zeros(MARK_STRETCHES << MARK_BITS, np.uint8)
    if len(listed) > LISTED_TERMS:
        marks = index.marks()
    if marks.mean() > 0.5:
        return F.expr(f"array_sort(transform({ngrams(text)}, x -> xxhash64(x)))")

    def marked(sent: Column, h: Column) -> Column:
        if len(listed) <= LISTED_TERMS:
            return h.isin(listed)
        first, *others = [F.substring(sent, p + 1, F.lit(1)) == F.lit(b"\x01") for p in _places(h)]
        for other in others:
            first = first & other
        return first

    def of_text(c: Column) -> Column:
        t, sent = c["t"], c["marks"]
        every = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: marked(sent, F.xxhash64(F.get(t, i))))
        pairs = F.transform(F.filter(starts, lambda i: i + 1 < F.size(t)), lambda i: F.xxhash64(F.concat(F.get(t, i), F.lit(" "), F.get(t, i + 1))))
        return F.array_sort(F.concat(F.transform(starts, lambda i: F.xxhash64(F.get(t, i))), F.filter(pairs, lambda h: marked(sent, h))))

    # bound to a lambda variable, so that a text is cut into tokens once and the plan holds the marks once
    bound = F.struct(F.expr(tokens(text)).alias("t"), F.lit(marks.tobytes() if marks.any() else b"").alias("marks"))
    return F.get(F.transform(F.array(bound), of_text), F.lit(0))


def query_vectors(asked: DataFrame, index: TfidfIndex) -> DataFrame:
    """(qh, terms, weights) of the distinct queries (qh, t): known terms, normalised."""
    counts = asked.groupBy("qh").agg(F.any_value("t").alias("t")).selectExpr("qh", "explode(t) AS h").groupBy("qh", "h").agg(F.count(F.lit(1)).alias("tf"))
    raw = counts.join(index.frequencies.select("h", "idf"), "h").select("qh", "h", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    return _vectors(raw, ["qh"])


def _bytes(setting: str) -> int:
    """Of a setting as 67108864b or 64m; 0 if it has another unit."""
    number, unit = setting.lower().rstrip("b"), 1
    if number[-1:] in ("k", "m"):
        number, unit = number[:-1], 1024 if number[-1] == "k" else 1 << 20
    return int(number) * unit if number.isdigit() else 0


def best_texts(vectors: DataFrame, index: TfidfIndex, k: int) -> tuple[DataFrame, int]:
    """(qh, text_id, similarity): the best ``k`` texts of every query, in passes over the blocks; and the number of queries."""
    spark = vectors.sparkSession
    if not 0 < _bytes(spark.conf.get(BATCH_KEY)) <= BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    keep = keeper(spark, "search")
    numbered = keep(vectors.withColumn("number", F.monotonically_increasing_id()), "queries")
    n, total, largest = numbered.agg(F.count(F.lit(1)), F.sum(F.size("terms")), F.max(F.size("terms"))).first()
    share = -(-(total or 0) // (2 * spark.sparkContext.defaultParallelism))
    passes = max(1, -(-(total or 0) // min(LARGEST_PASS, max(LEAST_PASS, share, largest or 0))))
    dealt = numbered.withColumn("turn", F.pmod(F.xxhash64("qh"), F.lit(passes)))
    found, written = [], []
    for i in range(passes):
        found.append(best_of_pass(index.blocks, dealt.where(F.col("turn") == i).select("number", "terms", "weights").collect(), k))
        if len(found) == PASSES_TOGETHER or i == passes - 1:
            together = found[0]
            for more in found[1:]:
                together = together.union(more)
            written.append(keep(together, f"found-{i}") if passes > PASSES_TOGETHER else together)
            found = []
    every = written[0]
    for more in written[1:]:
        every = every.union(more)
    best = Window.partitionBy("number").orderBy(F.desc("similarity"), F.asc("text_id"))
    top = every.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    return top.join(numbered.select("number", "qh"), "number").select("qh", "text_id", "similarity"), n


def search(queries: DataFrame, index: TfidfIndex, k: int = fv.HITS_PER_SEARCH, query_keys: list[str] | None = None, query: str = "query") -> DataFrame:
    """Top ``k`` documents of every query: (query keys…, rank, doc, similarity).

    Ordered by similarity, then document key; only positive similarities. The reported
    similarity has three decimals.
    """
    keys = query_keys or ["query_id"]
    # kept, because texts would otherwise be cut for the vectors and for the hits; queries without any known term have none
    kept = keeper(queries.sparkSession, "asked")(queries.select(*keys, known_terms(query, index).alias("t")), "terms")
    asked = kept.where("size(t) > 0").withColumn("qh", F.sha2(F.array_join("t", " "), 256))
    top, n = best_texts(query_vectors(asked, index), index, k)
    # no more than k copies of one text can be among k hits
    best_docs = Window.partitionBy("qh").orderBy(F.desc("similarity"), F.asc("doc"))
    hits = (
        top.join(index.docs.where(F.col("copy") <= k), "text_id")
        .withColumn("rank", F.row_number().over(best_docs))
        .where(F.col("rank") <= k)
        .select("qh", "rank", "doc", F.round("similarity", 3).alias("similarity"))
    )
    # many rows may ask one thing: few hits go to the rows, or else the rows of one query would meet in a task, or all be broadcast
    met = F.broadcast(hits) if n * k <= SENT_HITS else hits.hint("shuffle_merge")
    return asked.select(*keys, "qh").join(met, "qh").select(*keys, "rank", "doc", "similarity")


def code_corpus(descriptions: DataFrame, code_map: DataFrame) -> DataFrame:
    """Codes that have both a description and a map row: (icd10, description, cc, load_order).

    The first map row of a code counts; a category number that cannot be read is empty.
    """
    from riskspark.functions.codes import normalize_code, tolerant_int

    described = (
        descriptions.where("icd10 IS NOT NULL AND description IS NOT NULL")
        .selectExpr(f"{normalize_code('icd10')} AS icd10", "description", "load_order")
        .where("length(icd10) >= 3")
    )
    first = (
        code_map.selectExpr(f"{normalize_code('icd10')} AS icd10", f"coalesce(string({tolerant_int('cc')}), '') AS cc", "load_order")
        .groupBy("icd10")
        .agg(F.min_by("cc", "load_order").alias("cc"))
    )
    return described.join(first, "icd10").select("icd10", "description", "cc", "load_order")


def code_lookup(asked: DataFrame, corpus: DataFrame, code: str = "code") -> DataFrame:
    """Record of each asked code; empty columns for an unknown one. The last row wins."""
    from riskspark.functions.codes import normalize_code

    last = corpus.groupBy("icd10").agg(F.max_by(F.struct("description", "cc"), "load_order").alias("r"))
    keyed = asked.withColumn("icd10", F.expr(normalize_code(code)))
    return keyed.join(last, "icd10", "left").select(
        *asked.columns, "icd10", F.col("r.description").alias("description"), F.col("r.cc").alias("cc")
    )


def candidate_pool(conditions: DataFrame, index: TfidfIndex, k: int = fv.HITS_PER_CONDITION, key: str = "note_id", **options) -> DataFrame:
    """Candidates per note: a code stays with the first condition that found it.

    ``conditions`` is (note, ord, condition, search_query); an empty search query falls
    back to the condition. Position numbers the pool in the order of finding.
    """
    asked = conditions.withColumn(
        "query", F.coalesce(F.nullif("search_query", F.lit("")), F.col("condition"), F.lit(""))
    )
    hits = search(asked, index, k, [key, "ord", "condition"], "query", **options)
    # one shuffle, by note: hits of a note are few, so nothing is gained by sorting them on the map side
    found = hits.select(key, F.col("doc").alias("icd10"), "ord", "rank", "similarity", F.coalesce("condition", F.lit("")).alias("for_condition")).repartition(key)
    first = Window.partitionBy(key, "icd10").orderBy("ord", "rank", "similarity", "for_condition")
    pool = Window.partitionBy(key).orderBy("ord", "rank")
    kept = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("position", F.row_number().over(pool))


def ranked_pool(queries: DataFrame, index: TfidfIndex, k: int, case: str = "case_id", **options) -> DataFrame:
    """Evaluation pool: the first query that reaches a document fixes its similarity.

    (case, doc, similarity, ord, rank); order is similarity, then order of finding.
    """
    hits = search(queries, index, k, [case, "ord"], "query", **options)
    first = hits.groupBy(case, "doc").agg(F.min(F.struct("ord", "rank", "similarity")).alias("f"))
    return first.select(case, "doc", "f.similarity", "f.ord", "f.rank")
