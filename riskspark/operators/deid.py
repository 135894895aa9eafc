"""De-identification of a corpus of notes.

Pattern types are found by ordered passes inside each row. Names come from a table of
known names, joined with the distinct word n-grams of each note. Every match becomes
``[REDACTED_<TYPE>_<n>]``, numbered per type within a note; values are never kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import phi


def name_table(gazetteer: DataFrame) -> DataFrame:
    """(entity_type, name, n_tokens): names as lower-case token runs, distinct."""
    return (
        gazetteer.where(F.col("entity_type").isin(phi.GAZETTEER_TYPES))
        .selectExpr("entity_type", f"{phi.phrase_tokens('phrase')} AS t")
        .where("size(t) > 0")
        .selectExpr("entity_type", "array_join(t, ' ') AS name", "size(t) AS n_tokens")
        .distinct()
    )


#: Places of the hashes of names' first tokens, a byte each.
FIRST_TOKENS = 1 << 18


def _place(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FIRST_TOKENS)).cast("int")


def _runs(tokens: str, marks: bytes, lengths: list[int]) -> Column:
    """Distinct token runs of the given lengths, of those that start with a token that a name may start with."""

    def of_text(t: Column) -> Column:
        every = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1))
        starts = F.filter(every, lambda i: F.substring(F.lit(marks), _place(F.get(t, i)) + 1, F.lit(1)) == F.lit(b"\x01"))
        named = F.transform(starts, lambda i: F.array(*[F.when(i + n <= F.size(t), F.array_join(F.slice(t, i + 1, F.lit(n)), " ")) for n in lengths]))
        return F.array_distinct(F.flatten(named))

    # bound to a lambda variable, so that a text is cut into tokens once
    return F.get(F.transform(F.array(F.expr(tokens)), of_text), F.lit(0))


def names_in_notes(notes: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one array of names per type) for the notes that hold any known name.

    Only runs that start like a name travel, not texts; the result is as large as the matches.
    """
    names = name_table(gazetteer)
    # bounded: a mark for each place of a first token's hash, and the numbers of tokens that occur
    marks = bytearray(FIRST_TOKENS)
    for r in names.select(_place(F.substring_index("name", " ", 1)).alias("place")).distinct().collect():
        marks[r.place] = 1
    lengths = sorted(r.n_tokens for r in names.select("n_tokens").distinct().collect()) or [1]
    runs = notes.select(key, F.explode(_runs(phi.phrase_tokens(text), bytes(marks), lengths)).alias("name"))
    found = runs.join(names.select("entity_type", "name"), "name")
    return found.groupBy(key).agg(
        *[F.collect_set(F.when(F.col("entity_type") == t, F.col("name"))).alias(f"names_{t}") for t in phi.GAZETTEER_TYPES]
    )


def deidentify(
    notes: DataFrame,
    gazetteer: DataFrame | None = None,
    key: str = "note_id",
    text: str = "text",
    enabled: bool = True,
    fail_open: bool = False,
) -> DataFrame:
    """Adds sanitized_text, redacted, findings, enabled, note; drops the raw text.

    ``findings`` is an array of (entity_type, count): types in order, record numbers
    last. Where scanning is off or a text is missing the sanitized text is null, unless
    ``fail_open`` asks for the text to pass unchanged.
    """
    others = [c for c in notes.columns if c != text]
    if not enabled:
        passed = F.col(text) if fail_open else F.lit(None).cast("string")
        return notes.select(
            *others,
            passed.alias("sanitized_text"),
            F.lit(False).alias("redacted"),
            F.expr("cast(array() AS array<struct<entity_type:string,count:int>>)").alias("findings"),
            F.lit(False).alias("enabled"),
            F.lit("Guardrails disabled" if fail_open else "Guardrails disabled; text withheld").alias("note"),
        )

    df = notes
    passes: list[tuple[str, str]] = [(t, phi.sql_pattern(p)) for t, p in phi.PATTERNS.items()]
    if gazetteer is not None:
        df = df.join(names_in_notes(notes, gazetteer, key, text), key, "left")
        for t in phi.GAZETTEER_TYPES:
            # (?!) matches nowhere
            passes.append((t, f"coalesce({phi.names_pattern(f'names_{t}')}, '(?!)')"))
    state = phi.start_redaction(text)
    for entity, pattern in passes:
        needs = phi.NEEDS.get(entity, f"size(names_{entity}) > 0")
        state = phi.redaction_pass(state, pattern, f"[REDACTED_{entity}_", needs)
    state = phi.redaction_pass(state, phi.MRN, "MRN [REDACTED_MRN_", phi.NEEDS["MRN"])

    order = [t for t, _ in passes]
    counts = ", ".join(
        f"named_struct('entity_type', '{t}', 'count', state.n[{i}])"
        for t, i in [*sorted((t, i) for i, t in enumerate(order)), ("MRN", len(order))]
    )
    return df.selectExpr(*others, f"if({text} IS NOT NULL, {state}, null) AS state").selectExpr(
        *others,
        "state.s AS sanitized_text",
        "coalesce(exists(state.n, n -> n > 0), false) AS redacted",
        f"filter(array({counts}), x -> x.count > 0) AS findings",
        "true AS enabled",
        "if(state.s IS NULL, 'no text', null) AS note",
    )


def redact_mrn(notes: DataFrame, text: str = "text") -> DataFrame:
    """Only the record-number pass: adds sanitized_text and n_mrn."""
    others = [c for c in notes.columns if c != text]
    state = phi.redaction_pass(phi.start_redaction(text), phi.MRN, "MRN [REDACTED_MRN_", phi.NEEDS["MRN"])
    return notes.selectExpr(*others, f"if({text} IS NOT NULL, {state}, null) AS state").selectExpr(*others, "state.s AS sanitized_text", "state.n[0] AS n_mrn")


def findings_of_placeholders(placeholders: DataFrame, key: str = "note_id", column: str = "placeholder") -> DataFrame:
    """(key, entity_type, count) from a table of placeholders, one per row."""
    kind = F.expr(f"coalesce(get({phi.placeholder_types(column)}, 0), 'UNKNOWN')")
    return placeholders.groupBy(key, kind.alias("entity_type")).agg(F.count(F.lit(1)).alias("count"))


def findings_long(deid: DataFrame, key: str = "note_id") -> DataFrame:
    rows = deid.select(key, F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.select(key, "f.entity_type", "f.count")
