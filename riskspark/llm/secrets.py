"""Secret scans judged by how many owners hold a value.

Base patterns find what looks like a credential. The scan adds long mixed runs of letters and
digits. Then every value is counted over the corpus by its distinct repositories and owners: one
that several owners hold, or one owner in many repositories, is an example that was copied
around; one that a single owner holds in few of them is likely live. Base spans stay whatever
the counts say; added ones only if owner-specific.

Patterns run once over each text. What they find is written (no texts), exploded, and shuffled
by row or by hash of the value; a value that a third of all rows hold is first made distinct by
(value, owner, repository) on the map side, and adaptive execution splits its join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import Keep, let, text_of

#: The base patterns in order, (kind, pattern, group that holds the value).
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)
MIN_ASSIGN = 8
#: Added: runs that mix letters and digits and have enough different characters.
ADDED, ADDED_PATTERN, MIN_VARIETY = "owned", r"[A-Za-z0-9+/_=-]{20,}", 10
#: A value that more owners hold, or more repositories, is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3
KINDS = (*(k for k, _, _ in BASE), ADDED)


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """(kind, place, gap before, length, value) of each match, left to right.

    Matches don't overlap, so the pieces between them are the split by the same pattern. The
    shortest lengths of access and hex stand in their patterns: a run is matched whole or, if
    too short, not at all, wherever the match would begin.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def rows(m: Column) -> Column:
        parts = let(F.split(text, pattern, -1), lambda p: let(values, lambda v: F.transform(m, lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.cast("bigint").alias("i"), F.length(F.get(p, i)).cast("bigint").alias("gap"), F.length(x).cast("bigint").alias("len"), F.get(v, i).alias("value")))))
        return F.when(F.size(m) > 0, parts)

    return F.coalesce(let(matches, rows), F.array().cast("array<struct<kind:int,i:bigint,gap:bigint,len:bigint,value:string>>"))


def scanned(docs: DataFrame, text: str, owner: str, repository: str) -> DataFrame:
    """``docs`` without its text, with a row number, owner, repository and what the patterns find."""
    whole = text_of(text)
    found = F.concat(*[_found(whole, *p) for p in BASE], _found(whole, ADDED, ADDED_PATTERN, 0))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in docs.columns if c not in (text, owner, repository)], named(owner).alias("_owner"), F.concat_ws("/", named(owner), named(repository)).alias("_repository"), found.alias("_found"))


def spans_of(rows: DataFrame) -> DataFrame:
    """(_row, owner, repository, kind, start, end, value) in code points, failing matches dropped."""
    each = rows.where(F.size("_found") > 0).select("_row", "_owner", "_repository", F.explode("_found").alias("f")).select("_row", "_owner", "_repository", "f.*")
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    varied = (F.size(F.array_distinct(F.split("value", ""))) >= MIN_VARIETY) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    good = F.when(F.col("kind") == KINDS.index("assign"), F.length("value") >= MIN_ASSIGN).when(F.col("kind") == KINDS.index(ADDED), varied).otherwise(True)
    return placed.where(good).select("_row", "_owner", "_repository", "kind", "start", "end", F.sha2("value", 256).alias("hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of every candidate value."""
    held = spans.select("hash", "_owner", "_repository").distinct()
    by_owner = held.groupBy("hash", "_owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def joined_spans(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, keep: Keep, text: str = "text", owner: str = "source", repository: str = "lang", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """``docs`` without text, owner and repository, with spans and verdicts.

    ``base`` and ``spans`` are sorted arrays of (start, kind, end). ``n_live`` counts the spans
    whose value at most ``max_owners`` owners hold in at most ``max_repositories`` repositories,
    ``n_copied`` the others; ``most_owners`` and ``most_repositories`` are the largest numbers
    among the row's values. Null texts count as empty; null owners and repositories are one of
    their own. Repeated rows stay separate and their values belong to the same owner. Without
    documents, or without spans, arrays are empty and numbers 0.
    """
    made = ("base", "spans", "n_live", "n_copied", "most_owners", "most_repositories")
    rows = keep(scanned(docs.drop(*[c for c in made if c in docs.columns]), text, owner, repository), "scanned")
    spans = keep(spans_of(rows), "spans")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    known = spans.join(ownership(spans), "hash").withColumn("span", F.struct("start", "kind", "end")).withColumn("live", live)
    base = F.col("kind") < KINDS.index(ADDED)
    doc = known.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(base, F.col("span")))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), F.col("span")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    filled = {c: F.coalesce(c, none if c in ("base", "spans") else F.lit(0)) for c in made}
    return rows.drop("_owner", "_repository", "_found").join(doc, "_row", "left").drop("_row").withColumns(filled)
