"""De-identification, gate, reply intake, selection, history and prompts."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions import cards, phi
from riskspark.functions import notes as E
from riskspark.operators import deid, evaluate, history
from riskspark.plans import notes as N

NAMES = [("PERSON", "John Smith"), ("PERSON", "Ana Maria de la Cruz"), ("LOCATION", "Paris"), ("MEDICAL_LICENSE", "AB123456")]
NOTES = [
    (1, "John Smith is seen on 03/14/2026. MRN: 00456789. Contact 555-123-4567. Dx: diabetes, CKD stage 4. john   SMITH again."),
    (2, "Ana Maria de la Cruz, DOB 06/15/1951, email maria.g@example.com, SSN 123-45-6789, home in Paris. See https://x.org/a?b=1"),
    (3, "MRN: 00456789 and mrn 4432219; Medical Record review. +1 (743) 555-3824, 4316522678525456, 13.149.130.89"),
    (4, "Follow-up for morbid obesity. Parisian Smithson."),
    (5, None),
    (6, ""),
]


@pytest.fixture(scope="module")
def done(spark):
    notes = spark.createDataFrame(NOTES, "note_id int, text string")
    names = spark.createDataFrame(NAMES, "entity_type string, phrase string")
    return deid.deidentify(notes, names).cache(), names


def test_redaction(done):
    rows = {r.note_id: r for r in done[0].collect()}
    assert rows[1].sanitized_text == (
        "[REDACTED_PERSON_1] is seen on [REDACTED_DATE_TIME_1]. MRN [REDACTED_MRN_1]. Contact [REDACTED_PHONE_NUMBER_1]. "
        "Dx: diabetes, CKD stage 4. [REDACTED_PERSON_2] again."
    )
    assert rows[2].sanitized_text == (
        "[REDACTED_PERSON_1], DOB [REDACTED_DATE_TIME_1], email [REDACTED_EMAIL_ADDRESS_1], SSN [REDACTED_US_SSN_1], "
        "home in [REDACTED_LOCATION_1]. See [REDACTED_URL_1]"
    )
    assert rows[3].sanitized_text == (
        "MRN [REDACTED_MRN_1] and MRN [REDACTED_MRN_2]; MRN [REDACTED_MRN_3]. [REDACTED_PHONE_NUMBER_1], [REDACTED_CREDIT_CARD_1], [REDACTED_IP_ADDRESS_1]"
    )
    assert [(f.entity_type, f["count"]) for f in rows[1].findings] == [("DATE_TIME", 1), ("PERSON", 2), ("PHONE_NUMBER", 1), ("MRN", 1)]
    assert rows[4].sanitized_text == NOTES[3][1] and not rows[4].redacted
    assert rows[5].sanitized_text is None and rows[5].note == "no text"


def test_twice_is_once(done):
    again = deid.deidentify(done[0].selectExpr("note_id", "sanitized_text AS text"), done[1])
    first = {r.note_id: r.sanitized_text for r in done[0].collect()}
    assert {r.note_id: r.sanitized_text for r in again.collect()} == first
    assert not again.where("redacted").count()


def test_switched_off(spark):
    notes = spark.createDataFrame(NOTES[:1], "note_id int, text string")
    closed, opened = deid.deidentify(notes, enabled=False).first(), deid.deidentify(notes, enabled=False, fail_open=True).first()
    assert closed.sanitized_text is None and not closed.enabled
    assert opened.sanitized_text == NOTES[0][1] and opened.note == "Guardrails disabled"


def test_placeholder_counts(spark):
    df = spark.createDataFrame([(1, "[REDACTED_US_SSN_1]"), (1, "[REDACTED_US_SSN_2]"), (1, "odd")], "note_id int, placeholder string")
    assert {(r.entity_type, r["count"]) for r in deid.findings_of_placeholders(df).collect()} == {("US_SSN", 2), ("UNKNOWN", 1)}


def test_gate(spark):
    rows = ["x" * 80, "x" * 81, "a patient", "Patient on the plane", " \n\t", "", None]
    df = N.gate(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, sanitized_text string"))
    got = {r.i: (r.is_clinical, r.rejected) for r in df.collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, False), 3: (True, False), 4: (False, True), 5: (False, True), 6: (False, True)}


REPLIES = {
    1: '{"conditions":[{"condition":"a","search_query":"b"}]}',
    2: '```JSON\n{"conditions":[{"condition":"a"}]}\n``` ',
    3: '```json\n{"conditions":[]}\n``` and more',
    4: '[{"condition":"a"}]',
    5: '{"conditions":[{"condition":"a"',
    6: "",
    7: '{"other":1}',
    8: '  ```\n{"conditions":[{"condition":"c","search_query":null},{"condition":"d"}]}```',
}


def test_reply_intake(spark):
    df = spark.createDataFrame(list(REPLIES.items()), "note_id int, reply string")
    good, bad = N.parse_conditions(df)
    assert sorted((r.note_id, r.ord, r.condition, r.search_query) for r in good.collect()) == [(1, 1, "a", "b"), (2, 1, "a", None), (8, 1, "c", None), (8, 2, "d", None)]
    assert sorted(r.note_id for r in bad.collect()) == [3, 4, 5, 6]


def test_selection_and_fallback(spark):
    pool = spark.createDataFrame(
        [(n, f"C{p}", f"d{p}", "18", 1 - p / 100, "cond", p) for n in (1, 2, 3) for p in range(1, 31)],
        "note_id int, icd10 string, description string, cc string, similarity double, for_condition string, position int",
    )
    replies = spark.createDataFrame(
        [(1, '```json\n{"selected_codes":[{"icd10":"C9","confidence":0.95},{"icd10":""},{"description":"no code"}]}\n```'), (2, "prose"), (4, '{"selected_codes":[{"icd10":"C1"}]}')],
        "note_id int, reply string",
    )
    rows = N.selected_codes(pool, replies).collect()
    by_note = {n: [r.icd10 for r in sorted(rows, key=lambda r: r.pos) if r.note_id == n] for n in (1, 2, 3, 4)}
    five = ["C1", "C2", "C3", "C4", "C5"]
    assert by_note == {1: ["C9"], 2: five, 3: five, 4: []}
    prompts = {r.note_id: r.prompt for r in N.select_prompts(spark.createDataFrame([(1, "t")], "note_id int, sanitized_text string"), spark.createDataFrame([(1, 1, "a", "b")], "note_id int, ord int, condition string, search_query string"), pool).collect()}
    assert prompts[1].count('"icd10"') == 25 and prompts[1].startswith("Clinical notes:\nt\n\nExtracted conditions: [{")


def test_routing(spark):
    df = spark.createDataFrame([(1, " BETA ", None), (2, "what", ""), (3, "", "beta")], "note_id int, extract string, select string")
    rows = N.routing(df, {"extract": "alpha", "select": "alpha", "explain": "beta"}, ["alpha", "beta"]).orderBy("note_id").collect()
    assert [tuple(r)[1:] for r in rows] == [("beta", "alpha", "beta"), ("alpha", "alpha", "beta"), ("alpha", "beta", "beta")]


def test_cards(spark):
    df = spark.createDataFrame([(2.268,), (0.7,), (1.0,), (0.0,), (1.8,)], "s double")
    rows = df.selectExpr(f"{cards.score_tier('s')} AS t", f"{cards.percent_vs_average('s')} AS p").collect()
    assert [tuple(r) for r in rows] == [("high", "+126.8% vs avg"), ("mid", "-30.0% vs avg"), ("mid", "+0.0% vs avg"), ("low", "-100.0% vs avg"), ("high", "+80.0% vs avg")]


def test_history_runs_over_blocks(spark):
    turns = spark.range(257).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('call 555-123-4567 ', string(id)) AS text")
    messages = history.conversation_history(turns)
    rows = messages.orderBy("turn").collect()
    assert [r.messages for r in rows] == list(range(1, 258))
    assert "555" not in rows[0].content and "555" in rows[1].content
    small = history.running_sums(turns.withColumn("one", F.lit(1)), "conv_id", "turn", {"one": "n"}, block=10).orderBy("turn").collect()
    assert [r.n for r in small] == list(range(1, 258))
    assert history.history_of(messages, spark.createDataFrame([(1, 9)], "conv_id int, turn int")).count() == 10


def test_spread_documents_give_the_same_notes(spark):
    from riskspark import catalog
    from riskspark.plans import bindings

    rows = lambda: sorted(map(tuple, catalog.QUERIES["deidentify"](spark, "/root/testdata/sf0.001").collect()))
    one = rows()
    spark.conf.set(bindings.SPREAD_KEY, "5")
    try:
        assert bindings.table(spark, "/root/testdata/sf0.001", "documents").rdd.getNumPartitions() == 5
        assert rows() == one
    finally:
        spark.conf.unset(bindings.SPREAD_KEY)


def test_open_requests_and_their_messages(spark):
    rows = [
        (1, 0, "user", "SSN 123-45-6789"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (1, 3, "system", "later"),
        (2, 0, "user", "answered"), (2, 1, "assistant", "c"), (3, 5, "user", "first"), (3, 9, "user", "second"), (4, 0, None, "x"), (4, 1, "assistant", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    asked = history.open_requests(turns)
    assert sorted(map(tuple, asked.collect())) == [(1, 2), (3, 9)]
    prompts = spark.createDataFrame([(1, 0, "old"), (1, 2, "B"), (3, 9, "S"), (8, 1, "nobody")], "conv_id int, turn int, prompt string")
    sent = history.request_messages(history.conversation_history(turns), prompts).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in sent] == [
        (1, 2, 1, "user", "SSN [REDACTED_US_SSN_1]"), (1, 2, 2, "assistant", "a"), (1, 2, 3, "user", "B"), (3, 9, 1, "user", "first"), (3, 9, 2, "user", "S"),
    ]
    empty = turns.where("false")
    assert history.open_requests(empty).count() == 0 and history.request_messages(history.conversation_history(empty), prompts).count() == 0


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    pool = spark.createDataFrame([(1, "b", 0.9, 1, 1), (1, "a", 0.8, 1, 2), (1, "c", 0.8, 2, 1), (2, "x", 0.5, 1, 1)], "case_id int, doc string, similarity double, ord int, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "z"), (2, "q")], "case_id int, doc string")
    rows = {r.case_id: r for r in evaluate.retrieval_eval(cases, pool, gold, (1, 2)).collect()}
    assert (rows[1].mrr, rows[1].recall_1, rows[1].recall_2, rows[1].precision_pool, rows[1].n_missing) == (0.5, 0.0, 0.5, 0.333, 1)
    assert (rows[2].mrr, rows[2].recall_2, rows[2].n_missing) == (0.0, 0.0, 1)
    assert (rows[3].mrr, rows[3].recall_1, rows[3].n_retrieved, rows[3].precision_pool) == (0.0, 1.0, 0, 0.0)
    assert {tuple(r) for r in evaluate.retrieval_missing(pool, gold).collect()} == {(1, "z"), (2, "q")}
    predicted = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B")], "case_id int, icd10 string")
    wanted = spark.createDataFrame([(1, "A"), (1, "C"), (2, "D")], "case_id int, icd10 string")
    prf = {r.case_id: tuple(r)[1:] for r in evaluate.code_prf(cases, predicted, wanted, ["case_id"]).collect()}
    assert prf == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0)}


def test_phi_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "note_id int, expected array<string>, found array<string>, must_survive array<string>, sanitized_text string")
    r = evaluate.phi_means(evaluate.phi_cases_eval(empty)).first()
    assert (r.entity_precision, r.entity_recall, r.entity_f1, r.clinical_survival_rate) == (1.0, 1.0, 1.0, 1.0)


def test_audit(spark):
    clinical = spark.createDataFrame([(1, "Fine. You IDIOT")], "record_id int, output string")
    risky = spark.createDataFrame([(2, "SSN 123-45-6789 mail Bob@X.org MRN: AB-99 5", "see bob@x.org")], "record_id int, prompt string, output string")
    records = evaluate.audit_records(clinical, risky)
    found = {r.record_id: r.leaked for r in evaluate.leaks(records).collect()}
    assert found == {1: [], 2: ["Bob@X.org"]}
    assert evaluate.hit_rate(evaluate.leaks(records), "leaked", "leak_rate").first().leak_rate == 0.5
    assert {r.record_id: r.terms for r in evaluate.toxic_hits(records).collect()} == {1: ["idiot"], 2: []}
    assert evaluate.hit_rate(evaluate.leaks(records.where("false")), "leaked", "leak_rate").first().leak_rate == 0.0


def test_unfenced(spark):
    df = spark.createDataFrame([("``` a ```",), (" a ",)], "r string").selectExpr(f"{E.unfenced('r')} AS b")
    assert [r.b for r in df.collect()] == ["a", "a"]


def test_elements_are_told_by_their_json_type(spark):
    replies = ['["{not json", {"icd10":"I10"}]', '["{\\"icd10\\":\\"I11\\"}", 5, null, [1]]', '[{"icd10":7,"confidence":1.0},{}]', '"{"', "{}"]
    df = spark.createDataFrame([(i, f'{{"selected_codes":{r}}}') for i, r in enumerate(replies)], "note_id int, reply string")
    rows = df.selectExpr("note_id", f"{E.intake('reply', E.CODE, 'selected_codes')} AS i").selectExpr("note_id", "i.ok", "i.n_bad", "transform(i.items, x -> coalesce(x.icd10, '')) AS codes").orderBy("note_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(True, 1, ["I10"]), (True, 4, []), (True, 0, ["7", ""]), (True, 1, []), (True, 1, [])]


def test_dates_in_words_are_removed(spark):
    texts = ["Seen March 14, 2026 at noon", "on 3rd Sept. 2025.", "in may 2, 1999", "May be 12 or 2024", "May 2024", "Marching 14, 2026"]
    out = deid.deidentify(spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")).orderBy("note_id").collect()
    assert [r.sanitized_text for r in out] == ["Seen [REDACTED_DATE_TIME_1] at noon", "on [REDACTED_DATE_TIME_1].", "in [REDACTED_DATE_TIME_1]", *texts[3:]]


def test_names_of_any_length_and_none(spark):
    notes = spark.createDataFrame([(1, "Dr ann marie o'hara met Ann, ANN-MARIE and Bo"), (2, ""), (3, None), (4, "ann")], "note_id int, text string")
    names = [("PERSON", "Ann Marie"), ("PERSON", "bo"), ("LOCATION", "met ann ann marie and"), ("PERSON", "marie x")]
    table = lambda rows: spark.createDataFrame(rows, "entity_type string, phrase string")
    found = {r.note_id: (sorted(r.names_PERSON), r.names_LOCATION) for r in deid.names_in_notes(notes, table(names), "note_id", "text").collect()}
    assert found == {1: (["ann marie", "bo"], ["met ann ann marie and"])}
    assert deid.names_in_notes(notes, table([]), "note_id", "text").collect() == []


def test_audit_finds_what_a_switched_off_scan_lets_through(spark):
    notes = spark.createDataFrame(NOTES, "note_id int, text string").withColumn("identifiers", F.expr(phi.raw_identifiers("text")))
    said = spark.createDataFrame([(1, "Codes: none, call 555-123-4567. I hate it"), (4, None), (99, "nobody")], "note_id int, summary string")
    audit = lambda **how: {r.note_id: r for r in evaluate.pipeline_audit(deid.deidentify(notes, **how), said).collect()}
    on, off = audit(), audit(enabled=False, fail_open=True)
    assert set(on) == set(off) == {1, 2, 3, 4, 5, 6}
    assert [on[k].leaked_in_text for k in (1, 2, 3)] == [[], [], []]
    assert "123-45-6789" in off[2].leaked_in_text and "555-123-4567" in off[1].leaked_in_text
    assert on[1].leaked_in_summary == ["555-123-4567"] and on[1].terms == ["hate"] and not on[2].leaked_in_summary
    assert on[4].n_identifiers == 0 and not on[4].leaked_in_summary and not on[4].terms
    assert not on[5].leaked_in_text and not on[6].leaked_in_text
    withheld = audit(enabled=False)
    assert not any(r.leaked_in_text for r in withheld.values())
