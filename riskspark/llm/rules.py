"""Quality rules: counts of words and lines, and divergence from a language's distribution.

A document's histograms of character classes and of common words are compared with those of
its language by Jensen-Shannon distance (square root of the divergence in
bits: 0 for equal, 1 for disjoint histograms). A text too short for a stable histogram is not
judged by it. Everything is array expressions inside a row, two small aggregates and one
join with one row per language.

A reference is made of votes: of each document that passes the base rules, averaged by source and
then by language, so that neither a long text nor a source makes it. A text is rejected only if it
is far from all that a clean text could be like. Votes are whole numbers, so verdicts don't depend on how the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import SPACE, Keep, let, text_of, words_of

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "der", "die", "und", "den", "das", "von", "zu", "ist", "sich", "auf",
    "le", "la", "les", "et", "des", "est", "une", "pour", "que", "dans",
    "el", "los", "en", "por", "con", "una", "no", "se", "del", "las",
)
#: The base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Character classes beside letters; what is in none of them counts as other.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{N}", "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@^~_=+\\/{}\[\]]"}
#: Distances above which a text is rejected, with the least length from which they count:
#: (characters, distance of classes) and (common words, distance of words).
CLASS_GUARDS = ((200, 0.32), (1000, 0.22))
WORD_GUARD = (40, 0.85)
#: Parts into which a vote divides a histogram: of classes (few, as medians hold each value that occurs) and of words.
CLASS_PARTS, WORD_PARTS = 4096, 1 << 20
#: Languages whose references are sent to every task; with more they are joined by shuffle.
BROADCAST_LANGUAGES = 4096


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that occurs twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < 3, 0).otherwise(some)


def _common_histogram(words: Column) -> Column:
    listed = F.array(*map(F.lit, COMMON_WORDS))
    places = F.transform(F.filter(words, lambda w: w.isin(*COMMON_WORDS)), lambda w: F.array_position(listed, w))
    return let(places, lambda p: F.transform(F.sequence(F.lit(1), F.lit(len(COMMON_WORDS))), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("bigint")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules and both histograms, all of whole texts."""
    whole = text_of(text)
    has_word = lambda line: line.rlike(rf"[^{SPACE}]")
    lines = let(F.filter(F.split(whole, "\n"), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(words: Column) -> Column:
        none = (F.size(words) == 1) & (F.get(words, F.lit(0)) == "")
        return F.struct(
            F.when(none, 0).otherwise(F.size(words)).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeat_words(words).cast("bigint").alias("n_repeat_words"),
            _common_histogram(words).alias("common"),
        )

    without = lambda pattern: (F.length(whole) - F.length(F.regexp_replace(whole, f"{pattern}+", ""))).cast("bigint")
    found = docs.withColumn("_words", let(words_of(whole), of_words)).select(
        *[c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "_words.*",
        without(r"[#*$%&|<>]").alias("n_symbols"),
        lines.cast("bigint").alias("n_dup_lines"),
        F.array(*[without(p) for p in CLASSES.values()]).alias("_classes"),
        F.length(whole).cast("bigint").alias("_chars"),
    )
    letters = F.col("word_chars") - F.aggregate("_classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    classes = F.concat("_classes", F.array(letters, F.col("_chars") - F.col("word_chars")))
    return found.withColumn("classes", classes).drop("_classes")


def js_distance(left: Column, right: Column, kind: str = "bigint") -> Column:
    """Jensen-Shannon distance of two histograms of counts or shares; null if one is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast(kind), lambda a, x: a + x).cast("double")
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    both = lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2
    summed = let(F.struct(total(left).alias("l"), total(right).alias("r")), lambda t: F.aggregate(F.zip_with(left, right, lambda a, b: both(a / t["l"], b / t["r"])), F.lit(0.0), lambda a, x: a + x))
    return F.when((total(left) > 0) & (total(right) > 0), F.sqrt(F.greatest(summed, F.lit(0.0))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _votes(column: str, size: int, parts: int) -> list[Column]:
    """The bins' shares of a histogram in whole parts; null if it is empty."""
    total = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return [F.when(total > 0, F.floor(F.get(F.col(column), F.lit(i)) * parts / total)).alias(f"{column}{i}") for i in range(size)]


def voted_references(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, ref_classes, ref_common, all_classes), of documents that pass the base rules.

    A document's histogram is one vote for its source and a source's is one for its language:
    medians of parts of character classes (exact: a median holds at most the parts that occur),
    means of parts of common words. ``all_classes`` is the median over all sources of any language.
    """
    classes, common = ([f"{name}{i}" for i in range(size)] for name, size in (("classes", len(CLASSES) + 2), ("common", len(COMMON_WORDS))))
    votes = rows.where(~base_failed()).select(F.col(lang).alias("ref_lang"), F.col(source).alias("ref_source"), *_votes("classes", len(classes), CLASS_PARTS), *_votes("common", len(common), WORD_PARTS))
    middle = [F.percentile(c, F.lit(0.5)).alias(c) for c in classes]
    by_source = votes.groupBy("ref_lang", "ref_source").agg(*middle, *[F.floor(F.sum(c) / F.count(c)).alias(c) for c in common])
    own = by_source.groupBy("ref_lang").agg(*middle, *[(F.sum(c) / F.count(c)).alias(c) for c in common])
    every = by_source.agg(*middle).select(F.array(*classes).alias("all_classes"))
    # one row beside one row per language
    filled = lambda names: F.array(*[F.coalesce(c, F.lit(0.0)) for c in names])
    return own.select("ref_lang", filled(classes).alias("ref_classes"), filled(common).alias("ref_common")).join(F.broadcast(every))


def judged(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Measured rows with ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``, by voted references.

    Classes are compared with those of the language and of all sources, whichever is nearer;
    words with those of the language and the listed words of English, German, French and
    Spanish. No number of documents changes the rule.
    """
    refs = voted_references(rows, lang, source)
    few = refs.select("ref_lang").limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    joined = rows.join(F.broadcast(refs) if few else refs, rows[lang].eqNullSafe(refs["ref_lang"]), "left")
    real = lambda name: F.transform(name, lambda x: x.cast("double"))
    listed = [F.array(*[F.lit(float(i // 10 == k)) for i in range(len(COMMON_WORDS))]) for k in range(len(COMMON_WORDS) // 10)]
    nearest = lambda name, refs_: F.coalesce(F.least(*[js_distance(real(name), r, "double") for r in refs_]), F.lit(0.0))
    common = F.aggregate("common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    found = joined.withColumn("class_distance", nearest("classes", [F.col("ref_classes"), F.col("all_classes")]))
    found = found.withColumn("word_distance", nearest("common", [F.col("ref_common"), *listed]))
    far = (common >= WORD_GUARD[0]) & (F.col("word_distance") > WORD_GUARD[1])
    for chars, distance in CLASS_GUARDS:
        far = far | (F.col("_chars") >= chars) & (F.col("class_distance") > distance)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


#: Columns that the verdict adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def _packed(docs: DataFrame, carried: list[str], text: str, lang: str, source: str) -> DataFrame:
    """Columns to carry in one struct, beside text, language and source."""
    other = lambda c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("_doc"), F.col(f"`{text}`").alias("text"), other(lang).alias("_lang"), other(source).alias("_source"))


def quality(docs: DataFrame, keep: Keep, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the text, with counts, distances and verdicts.

    Null texts count as empty: no words, so the base rules reject them. A null language is a
    language and a null source a source; so is a missing column. Equal rows are judged alike and
    stay separate. Without documents the result is empty. Columns of ``docs`` that have the
    name of one that is added are replaced; all others stay.
    """
    carried = [c for c in docs.columns if c != text and c not in MADE]
    rows = keep(measured(_packed(docs, carried, text, lang, source)).drop("text"), "measured")
    return judged(rows, "_lang", "_source").select(*[F.col(f"_doc.`{c}`") for c in carried], *MADE)


def accepted(docs: DataFrame, keep: Keep, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns: texts are kept beside the counts."""
    rows = keep(measured(_packed(docs, docs.columns, text, lang, source)).drop("text"), "measured")
    return judged(rows, "_lang", "_source").where("kept").select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
