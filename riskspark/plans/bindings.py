"""Views of the benchmark tables in the shape the jobs expect.

Only column expressions: members from ``customer``, the code map and descriptions from
``part``, diagnoses from order lines, notes from ``documents``.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources import fixed_values as fv
from riskspark.sources.refdata import RefData


#: A caller's setting: the number of partitions to which rows of ``documents`` are dealt. For files
#: with fewer row groups than cores only; unset, as on large tables, nothing moves.
SPREAD_KEY = "spark.riskspark.documents.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD_KEY, None) if name == "documents" else None
    return rows.repartition(int(spread)) if spread else rows


def write_model_folder(spark: SparkSession, path: str, times: int) -> None:
    """A folder of model tables, under names of its own, with all coefficients ``times`` the built-in ones."""
    texts = {"a/order": fv.HIERARCHIES, "a/sets": fv.DIAGNOSIS_GROUPS, "pairs": fv.INTERACTIONS, "b/weights-1": fv.CE_FACTORS, "b/weights-2": fv.NE_FACTORS}
    for name, text in texts.items():
        header, *rows = csv.reader(io.StringIO(text.strip()))
        frame = spark.createDataFrame([[v.strip() or None for v in (*r, *[""] * (len(header) - len(r)))] for r in rows if r], ", ".join(f"`{c.strip()}` string" for c in header))
        scaled = {c: F.col(c).cast("decimal(12,3)") * times for c in frame.columns if c in fv.CE_MODELS + fv.NE_MODELS}
        frame.withColumns(scaled).coalesce(1).write.option("header", True).csv(f"{path}/{name}")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS member_id",
        "date_add(DATE '1920-01-01', int((c_custkey * 7919) % 32000)) AS dob",
        "int(1 + c_custkey % 2) AS sex",
        "int((c_custkey div 2) % 4) AS orec",
        "int(c_nationkey % 3) AS dual_status",
        "if(c_custkey % 20 = 0, 1, 0) AS ltimcaid",
        "if(c_mktsegment = 'BUILDING', 1, 0) AS nemcaid",
    )


PART_CODE = "concat('Z', lpad(string({key}), greatest(5, length(string({key}))), '0'))"


def code_map(spark: SparkSession, sf_dir: str, ref: RefData) -> DataFrame:
    domain = ",".join(h[3:] for h in ref.domain)
    return table(spark, sf_dir, "part").selectExpr(
        f"{PART_CODE.format(key='p_partkey')} AS icd10",
        f"get(split('{domain}', ','), int(p_partkey % 89)) AS cc",
        "if(p_size % 7 = 0, 'age >= 18 and age < 90', null) AS MCE_AGE_CONDITION",
        "CASE p_size % 10 WHEN 0 THEN 'age >= 65' WHEN 1 THEN 'age < 65' WHEN 2 THEN 'age 50+' WHEN 3 THEN 'age == 18'"
        " WHEN 4 THEN '(age >= 12 and age <= 55)' WHEN 5 THEN '(age < 30) or (age > 60)' WHEN 6 THEN 'age >= 18 and (age < 80)'"
        " WHEN 7 THEN 'not age >= 70' WHEN 8 THEN 'not (age > 40 or (age < 20))' END AS AGE_EDIT_CONDITION",
        "CASE p_size % 9 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'N/A' END AS SEX_EDIT_CONDITION",
        "p_partkey AS load_order",
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        f"{PART_CODE.format(key='p_partkey')} AS icd10",
        "concat_ws(' ', p_name, lower(p_type), lower(p_brand)) AS description",
        "p_partkey AS load_order",
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line, written the way people type codes: z00.012 + blank."""
    return diagnoses_of_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def diagnoses_of_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lines.select("l_orderkey", "l_partkey", "l_shipdate")
    orders = orders.select("o_orderkey", "o_custkey")
    code = f"lower({PART_CODE.format(key='l_partkey')})"
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "o_custkey AS member_id",
        f"concat(substr({code}, 1, 3), '.', substr({code}, 4), ' ') AS icd10",
        "to_date(l_shipdate) AS service_date",
    )


# notes ---------------------------------------------------------------------------------

#: Identifiers appended to notes by a rule on the document number, and the types that
#: each rule makes one expect.
NOTE_TAILS = {
    0: (
        "concat(' Patient Customer#', lpad(CAST(doc_id % 100 AS STRING), 9, '0'), ' seen 03/1', CAST(doc_id % 10 AS STRING), '/2026. MRN: 00', "
        "lpad(CAST(doc_id % 1000000 AS STRING), 6, '0'), '.')",
        ["PERSON", "DATE_TIME", "MRN"],
    ),
    1: (
        "concat(' Call 555-123-', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), ' or write u', CAST(doc_id AS STRING), '@example.com')",
        ["PHONE_NUMBER", "EMAIL_ADDRESS"],
    ),
    2: (
        "concat(' SSN 123-45-', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), ', see https://records.example.org/n/', CAST(doc_id AS STRING))",
        ["US_SSN", "URL"],
    ),
    3: (
        "concat(' Medical record number #A-', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'), ' in NATION_', CAST(doc_id % 25 AS STRING))",
        ["MRN", "LOCATION"],
    ),
    4: ("concat(' Signed Supplier#', lpad(CAST(doc_id % 10 AS STRING), 9, '0'))", ["MEDICAL_LICENSE"]),
}


def note_text() -> str:
    """Whole document text followed by its identifiers; plain in Spark and other SQL."""
    cases = " ".join(f"WHEN {k} THEN {expr}" for k, (expr, _) in NOTE_TAILS.items())
    return f"concat(text, CASE doc_id % 8 {cases} ELSE '' END)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS note_id", f"{note_text()} AS text")


def notes_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that end in words of a code's description; those beyond the last code have none."""
    findings = table(spark, sf_dir, "part").selectExpr("p_partkey AS note_id", "concat(' Assessment: ', p_name, ' ', lower(p_type)) AS finding")
    return notes(spark, sf_dir).join(findings, "note_id", "left").selectExpr("note_id", "concat(text, coalesce(finding, '')) AS text")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names: customers, nations and suppliers."""
    people = table(spark, sf_dir, "customer").selectExpr("'PERSON' AS entity_type", "c_name AS phrase")
    places = table(spark, sf_dir, "nation").selectExpr("'LOCATION' AS entity_type", "n_name AS phrase")
    licences = table(spark, sf_dir, "supplier").selectExpr("'MEDICAL_LICENSE' AS entity_type", "s_name AS phrase")
    return people.unionByName(places).unionByName(licences)


SURVIVORS = r"regexp_extract_all(text, r'\p{L}{4,}', 0)"
#: Words of the note tails that stand beside an identifier and are none.
TAIL_SURVIVORS = {0: ["Patient", "seen"], 1: ["Call", "write"], 2: ["see"], 3: ["in"], 4: ["Signed"]}
TAIL_WORDS = (
    "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN array({', '.join(repr(t) for t in words)})" for k, words in TAIL_SURVIVORS.items()) + " ELSE cast(array() AS array<string>) END"
)


def phi_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with the types to expect and words that must survive: the document's first and
    last two, and the word before each identifier that a rule appends."""
    expected = " ".join(f"WHEN {k} THEN array({', '.join(repr(t) for t in types)})" for k, (_, types) in NOTE_TAILS.items())
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS note_id",
        f"{note_text()} AS text",
        f"CASE doc_id % 8 {expected} ELSE cast(array() AS array<string>) END AS expected",
        f"transform(array({SURVIVORS}), w -> concat(slice(w, 1, 2), slice(w, greatest(1, size(w) - 1), 2), {TAIL_WORDS}))[0] AS must_survive",
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded extraction replies, one per part: fenced, bare or cut short."""
    body = (
        "to_json(named_struct('conditions', array("
        "named_struct('condition', p_name, 'search_query', concat(p_name, ' ', lower(p_type))), "
        "named_struct('condition', lower(p_type), 'search_query', ''))))"
    )
    written = (
        "CASE WHEN p_partkey % 11 = 0 THEN substr(body, 1, length(body) - 5) WHEN p_partkey % 7 = 0 THEN body "
        "ELSE concat('```json\\n', body, '\\n```') END"
    )
    # a small file has few row groups and its replies take long to read, so they are dealt out first
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.selectExpr("p_partkey AS note_id", f"transform(array({body}), body -> {written})[0] AS reply")


def selection_replies(pool: DataFrame) -> DataFrame:
    """Recorded selection replies: the first three candidates, or prose for every fifth note."""
    picked = pool.where("position <= 3").groupBy("note_id").agg(
        F.expr(
            "to_json(named_struct('selected_codes', transform(array_sort(collect_list(struct(position, icd10, description, cc, for_condition))),"
            " x -> named_struct('icd10', x.icd10, 'description', x.description, 'cc', x.cc, 'condition', x.for_condition,"
            " 'rationale', 'candidate', 'confidence', 1D - x.position / 10D))))"
        ).alias("body")
    )
    return picked.selectExpr("note_id", "if(note_id % 5 = 0, 'I would pick the first ones.', concat('```json\\n', body, '\\n```')) AS reply")


#: Places of hashes of passages' anchors and of their first tokens, a byte each.
ANCHOR_PLACES = 1 << 18


def anchors_in(tokens: str, first: bytes, marks: bytes, lengths: list[int]) -> Column:
    """Distinct (n, anchor) of the runs of ``n`` tokens that start at a marked token and have a marked place.

    An anchor hashes a run's token hashes.
    """
    marked = lambda where, x: F.substring(F.lit(where), anchor_place(x) + 1, F.lit(1)) == F.lit(b"\x01")

    def of_text(h: Column) -> Column:
        every = F.when(F.size(h) > 0, F.sequence(F.lit(1), F.size(h)))
        starts = F.filter(every, lambda i: marked(first, F.element_at(h, i)))
        anchor = lambda i, n: F.when(i + (n - 1) <= F.size(h), F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice(h, i, F.lit(n))).alias("anchor")))
        runs = F.flatten(F.transform(starts, lambda i: F.array(*[anchor(i, n) for n in lengths])))
        return F.array_distinct(F.filter(runs, lambda a: marked(marks, a["anchor"])))

    # bound to a lambda variable, so that a text is cut and hashed once for all lengths
    return F.get(F.transform(F.array(F.expr(f"transform({tokens}, x -> xxhash64(x))")), of_text), F.lit(0))


def anchor_place(anchor: Column) -> Column:
    return F.pmod(anchor, F.lit(ANCHOR_PLACES)).cast("int")


def gold_passages(spark: SparkSession, sf_dir: str, keep=lambda df, step: df) -> tuple[DataFrame, DataFrame]:
    """(cases, gold): passages as queries, the documents that hold them as gold.

    A passage and a document meet on a run of tokens that starts at the passage's second one
    (its first and last may be glued to other letters) and has eight tokens, or all but the
    ends of a shorter passage; then the whole passage is compared. Documents are read once and
    leave the row only where a run's place is marked by some passage. Every item is a case with
    two queries, the passage and its first forty characters. Every third item also has a gold
    document that no corpus holds, so recall below one and missing gold do occur, and items
    that no document holds are cases without gold (or with only that one).
    """
    from riskspark.functions.text import tokens

    items = keep(
        table(spark, sf_dir, "benchmark")
        .selectExpr("item_id AS case_id", "text AS query", f"transform({tokens('text')}, x -> xxhash64(x)) AS h")
        .selectExpr("case_id", "query", "h", "greatest(1, least(8, size(h) - 2)) AS n")
        .selectExpr("case_id", "query", "n", "slice(h, if(size(h) > 2, 2, 1), n) AS h")
        .selectExpr("case_id", "query", "n", "get(h, 0) AS first", "xxhash64(h) AS anchor"),
        "items",
    )
    # bounded: marks for the places of anchors and first tokens, and the lengths that occur, eight at most
    first, marks = bytearray(ANCHOR_PLACES), bytearray(ANCHOR_PLACES)
    for column, places in (("first", first), ("anchor", marks)):
        for r in items.select(anchor_place(F.col(column)).alias("place")).where("place IS NOT NULL").distinct().collect():
            places[r.place] = 1
    lengths = sorted(r.n for r in items.select("n").distinct().collect()) or [8]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    runs = docs.select("doc", F.explode(anchors_in(tokens("text"), bytes(first), bytes(marks), lengths)).alias("a")).select("doc", "a.*")
    near = runs.join(items.select("case_id", "n", "anchor"), ["n", "anchor"]).select("doc", "case_id").distinct()
    held = near.join(docs, "doc").join(items.select("case_id", "query"), "case_id")
    lost = items.where("case_id % 3 = 0").selectExpr("case_id", "-1 - case_id AS doc")
    gold = keep(held.where("contains(text, query)").select("case_id", "doc").unionByName(lost), "gold")
    cases = items.selectExpr("case_id", "posexplode(array(query, substr(query, 1, 40))) AS (pos, query)").selectExpr("case_id", "pos + 1 AS ord", "query")
    return cases, gold


def provider_outputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two recorded providers over the orders: codes, gold, step timings, members.

    Every order is a case of both, also where one predicts nothing. Gold lacks each order's
    second line, so there are false positives, and all lines of every seventh order.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS case_id", f"{PART_CODE.format(key='l_partkey')} AS icd10", "l_returnflag", "l_linenumber", "l_quantity"
    )
    provider = F.expr(
        "explode(filter(array(if(l_returnflag IN ('A', 'N'), 'alpha', null), if(l_returnflag IN ('N', 'R'), 'beta', null)), x -> x IS NOT NULL))"
    )
    predicted = lines.select("case_id", provider.alias("provider"), "icd10", "l_linenumber", "l_quantity")
    both = F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("provider")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), both)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS case_id", "o_custkey AS member_id")
    return {
        "predicted": predicted,
        "gold": lines.where("l_linenumber != 2 AND case_id % 7 != 0").select("case_id", "icd10"),
        "timings": predicted.selectExpr(
            "case_id", "provider", "if(l_linenumber % 2 = 0, 'select', 'extract') AS step", "l_quantity / 10 AS seconds"
        ),
        "cases": cases,
        "members": orders.join(members(spark, sf_dir), "member_id"),
    }


def audit_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clinical, phi) records: even notes carry identifiers, and every third output
    repeats its prompt."""
    records = notes(spark, sf_dir).selectExpr(
        "note_id AS record_id",
        "text AS prompt",
        "concat('Identified ICD-10 codes: Z', string(note_id), '.', if(note_id % 3 = 0, concat(' ', upper(text)), '')) AS output",
    )
    return records.where("record_id % 2 = 1"), records.where("record_id % 2 = 0")
