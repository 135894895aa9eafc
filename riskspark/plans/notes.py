"""From notes to codes and scores, with recorded model replies as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import notes as N
from riskspark.operators import history
from riskspark.operators.deid import deidentify
from riskspark.operators.model import joined_hccs, joined_interactions
from riskspark.operators.retrieval import TfidfIndex, candidate_pool
from riskspark.plans.roster import score_roster
from riskspark.sources import fixed_values as fv
from riskspark.sources.refdata import RefData


def gate(notes: DataFrame, text: str = "sanitized_text") -> DataFrame:
    """Adds is_clinical and rejected (nothing but white space)."""
    return notes.selectExpr(
        "*",
        f"{N.keyword_hits(text)} AS keyword_hits",
        f"coalesce({N.is_clinical(text)}, false) AS is_clinical",
        f"coalesce({N.stripped(text)} = '', true) AS rejected",
    )


def parse_conditions(completions: DataFrame, key: str = "note_id", reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(conditions, quarantine): one row per condition, and the replies without an object or
    with elements that are none; their good elements count all the same."""
    read = completions.selectExpr("*", f"{N.intake(reply, N.CONDITION, 'conditions')} AS intake")
    conditions = (
        read.selectExpr(key, "posexplode_outer(if(intake.ok, intake.items, null)) AS (pos, c)")
        .where("pos IS NOT NULL")
        .selectExpr(key, "pos + 1 AS ord", "c.condition AS condition", "c.search_query AS search_query")
    )
    return conditions, read.where("NOT intake.ok OR intake.n_bad > 0").withColumn("n_bad", F.col("intake.n_bad")).drop("intake")


def note_conditions(notes: DataFrame, conditions: DataFrame, completions: DataFrame, key: str = "note_id") -> DataFrame:
    """Conditions of the notes; a note without any recorded reply is its own query."""
    without = notes.join(completions.select(key), key, "left_anti").selectExpr(
        key, "1 AS ord", "string(null) AS condition", "sanitized_text AS search_query"
    )
    return conditions.join(notes.select(key), key, "left_semi").unionByName(without)


def selected_codes(pool: DataFrame, replies: DataFrame, key: str = "note_id", reply: str = "reply") -> DataFrame:
    """Codes the selector chose; the first few candidates where its reply cannot be read.

    ``pool`` has icd10, description, cc, similarity, for_condition and position. Result:
    (note, pos, icd10, description, cc, condition, confidence, similarity).
    """
    offered = pool.where(F.col("position") <= fv.CANDIDATES_TO_SELECTOR)
    with_pool = offered.select(key).distinct()
    read = replies.selectExpr(key, f"{N.intake(reply, N.CODE, 'selected_codes')} AS intake")
    chosen = (
        read.join(with_pool, key, "left_semi")
        .selectExpr(key, "posexplode_outer(if(intake.ok, intake.items, null)) AS (p, c)")
        .where("p IS NOT NULL")
        .selectExpr(
            key, "p + 1 AS pos", "c.icd10", "coalesce(c.description, '') AS description", "coalesce(c.cc, '') AS cc",
            "coalesce(c.condition, '') AS condition", "try_cast(c.confidence AS double) AS confidence", "double(null) AS similarity",
        )
        .where("icd10 != ''")
    )
    fallback = (
        offered.where(F.col("position") <= fv.FALLBACK_CODES)
        .join(read.where("intake.ok").select(key), key, "left_anti")
        .selectExpr(
            key, "position AS pos", "icd10", "description", "cc", "for_condition AS condition", "double(null) AS confidence", "similarity"
        )
    )
    return chosen.unionByName(fallback)


def pool_with_records(pool: DataFrame, corpus: DataFrame) -> DataFrame:
    return pool.join(corpus.groupBy("icd10").agg(F.max_by(F.struct("description", "cc"), "load_order").alias("r")), "icd10").select(
        *pool.columns, F.col("r.description").alias("description"), F.col("r.cc").alias("cc")
    )


def note_to_score(
    notes: DataFrame,
    completions: DataFrame,
    make_replies,
    members: DataFrame,
    corpus: DataFrame,
    code_map: DataFrame,
    index: TfidfIndex,
    ref: RefData,
    gazetteer: DataFrame | None = None,
    keep=lambda df, step: df,
) -> tuple[DataFrame, DataFrame]:
    """De-identify, gate, extract, retrieve, select, score: (selected codes, scores)."""
    _, codes, scored = note_steps(notes, completions, make_replies, members, corpus, code_map, index, ref, gazetteer, keep)
    return codes, scored


def note_steps(
    notes: DataFrame,
    completions: DataFrame,
    make_replies,
    members: DataFrame,
    corpus: DataFrame,
    code_map: DataFrame,
    index: TfidfIndex,
    ref: RefData,
    gazetteer: DataFrame | None = None,
    keep=lambda df, step: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``note_to_score`` with all sanitized notes in front, also those that the gate stops.

    ``completions`` are recorded extraction replies, ``make_replies(pool)`` gives the
    recorded selection replies. ``members`` is keyed by ``note_id`` and holds the
    demographics of each note's patient; only notes with codes and demographics score.
    ``keep`` may write a step that several later ones use.
    """
    every = keep(gate(deidentify(notes, gazetteer)), "sanitized")
    sanitized = every.where("is_clinical AND NOT rejected")
    conditions, _ = parse_conditions(completions)
    asked = note_conditions(sanitized, conditions, completions)
    pool = keep(pool_with_records(candidate_pool(asked, index), corpus), "pool")
    codes = keep(selected_codes(pool, make_replies(pool)), "codes")
    scored = score_roster(members, codes.select("note_id", "icd10"), code_map, ref, key="note_id", scored_only=True)
    return every, codes, scored


def summaries(codes: DataFrame, scored: DataFrame, ref: RefData, key: str = "note_id") -> DataFrame:
    """(note, summary): one line for each note with codes, scored or not."""
    with_hccs = scored.withColumn("hccs", F.expr(joined_hccs("hcc_active", ref)))
    return code_lists(codes, key).select(key, "codes").join(with_hccs, key, "left").selectExpr(key, f"{summary_line('codes', 'hccs')} AS summary")


def summary_line(codes: str, hccs: str) -> str:
    """SQL text of the one-line summary of a result; blanks separate list entries."""
    listed = lambda c: f"replace(coalesce({c}, ''), ' ', ', ')"
    return (
        f"concat('{fv.SUMMARY_CODES}', {listed(codes)}, '{fv.SUMMARY_HCCS}', {listed(hccs)}, "
        f"'{fv.SUMMARY_MODEL}', coalesce(applicable_model, 'None'), '{fv.SUMMARY_SCORE}', coalesce(string(applicable_score), 'None'), '.')"
    )


def code_lists(codes: DataFrame, key: str = "note_id") -> DataFrame:
    """Codes of a note in order, as one text; a note has at most the selector's list."""
    return codes.groupBy(key).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(pos, icd10))), x -> x.icd10), ' ')").alias("codes"),
        F.expr(
            "transform(array_sort(collect_list(struct(pos, concat(icd10, ' (', description, ', CC', cc, ')') AS t))), x -> x.t)"
        ).alias("code_texts"),
    )


def _quoted(items: str) -> str:
    return rf"concat('[', array_join(transform({items}, x -> concat('\'', x, '\'')), ', '), ']')"


def explain_prompts(notes: DataFrame, conditions: DataFrame, codes: DataFrame, scored: DataFrame, ref: RefData, key: str = "note_id") -> DataFrame:
    """(note, prompt): the text and, under a separator, whatever results exist for it."""
    names = conditions.groupBy(key).agg(
        F.expr("transform(array_sort(collect_list(struct(ord, coalesce(condition, '') AS t))), x -> x.t)").alias("condition_texts")
    )
    results = scored.select(
        key,
        F.expr(joined_hccs("hcc_active", ref)).alias("hccs"),
        F.expr(joined_interactions(ref)).alias("inter"),
        "applicable_model",
        "applicable_score",
        F.expr("concat('{', concat_ws(', ', " + ", ".join(rf"concat('\'{m}\': ', string({m}))" for m in ref.ce_models) + "), '}')").alias("ce"),
    )
    df = notes.join(names, key, "left").join(code_lists(codes, key), key, "left").join(results, key, "left")
    blank = lambda c: f"filter(split({c}, ' '), x -> x != '')"
    parts = ", ".join(
        [
            f"if(size(condition_texts) > 0, concat('{fv.EXPLAIN_CONDITIONS}', {_quoted('condition_texts')}), null)",
            f"if(size(code_texts) > 0, concat('{fv.EXPLAIN_CODES}', {_quoted('code_texts')}), null)",
            f"if(applicable_model IS NOT NULL, concat('{fv.EXPLAIN_HCCS}', {_quoted(blank('hccs'))}, '\\n{fv.EXPLAIN_MODEL}', applicable_model,"
            f" '\\n{fv.EXPLAIN_SCORE}', string(applicable_score), '\\n{fv.EXPLAIN_CE_SCORES}', ce, '\\n{fv.EXPLAIN_INTERACTIONS}', {_quoted(blank('inter'))}), null)",
        ]
    )
    return df.selectExpr(key, "sanitized_text", f"concat_ws('\\n', {parts}) AS context").selectExpr(
        key,
        "if(context = '', sanitized_text, concat(sanitized_text,"
        f" '\\n\\n{fv.EXPLAIN_RESULTS}\\n', context)) AS prompt",
    )


def select_prompts(notes: DataFrame, conditions: DataFrame, pool: DataFrame, key: str = "note_id") -> DataFrame:
    """(note, prompt) for the selector: text, conditions and at most 25 candidates as JSON."""
    listed = conditions.groupBy(key).agg(
        F.expr("to_json(transform(array_sort(collect_list(struct(ord, condition, search_query))), x -> struct(x.condition, x.search_query)))").alias("c")
    )
    offered = (
        pool.where(F.col("position") <= fv.CANDIDATES_TO_SELECTOR)
        .groupBy(key)
        .agg(
            F.expr(
                "to_json(transform(array_sort(collect_list(struct(position, icd10, description, cc, similarity, for_condition))),"
                " x -> struct(x.icd10, x.description, x.cc, x.similarity, x.for_condition)))"
            ).alias("k")
        )
    )
    return notes.join(offered, key).join(listed, key, "left").selectExpr(
        key,
        f"concat('{fv.SELECT_NOTES}\\n', sanitized_text, '\\n\\n{fv.SELECT_CONDITIONS}', coalesce(c, '[]'), '\\n\\n{fv.SELECT_CANDIDATES}\\n', k) AS prompt",
    )


def request_messages(
    turns: DataFrame,
    completions: DataFrame,
    make_replies,
    members: DataFrame,
    corpus: DataFrame,
    code_map: DataFrame,
    index: TfidfIndex,
    ref: RefData,
    gazetteer: DataFrame | None = None,
    keep=lambda df, step: df,
) -> DataFrame:
    """What the explaining step is sent for every open request of ``turns``: history, then the request with its results.

    (conv_id, turn, position, role, content) from (conv_id, turn, role, text). The other inputs
    are those of ``note_to_score``, keyed by ``note_id``, which is the conversation here. A request
    that the gate doesn't take for clinical is sent without results; an empty one isn't sent.
    """
    said = keep(history.conversation_history(turns, gazetteer), "history")
    own = said.join(history.open_requests(turns), ["conv_id", "turn"], "left_semi")
    requests = keep(gate(own.selectExpr("conv_id AS note_id", "turn", "content AS sanitized_text")).where("NOT rejected"), "requests")
    clinical = requests.where("is_clinical").select("note_id")
    conditions = keep(parse_conditions(completions)[0].join(clinical, "note_id", "left_semi"), "conditions")
    pool = keep(pool_with_records(candidate_pool(conditions, index), corpus), "pool")
    codes = keep(selected_codes(pool, make_replies(pool)), "codes")
    scored = score_roster(members, codes.select("note_id", "icd10"), code_map, ref, key="note_id", scored_only=True)
    prompts = explain_prompts(requests, conditions, codes, scored, ref).join(requests.select("note_id", "turn"), "note_id")
    return history.request_messages(said, prompts.withColumnRenamed("note_id", "conv_id"))


def pending_prompts(prompts: DataFrame, outputs: DataFrame, key: str = "note_id") -> DataFrame:
    """Prompts that have no recorded output yet."""
    return prompts.join(outputs.select(key), key, "left_anti")


def routing(requests: DataFrame, defaults: dict[str, str], available: list[str], key: str = "note_id") -> DataFrame:
    """One provider column per step, from optional override columns of the same name."""
    given = lambda s: f"string({s})" if s in requests.columns else "string(null)"
    return requests.selectExpr(key, *[f"{N.resolved_provider(given(s), d, available)} AS {s}" for s, d in defaults.items()])
