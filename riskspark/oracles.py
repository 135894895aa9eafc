"""Plain-SQL twins of the queries, for checking results on another engine.

The logic is written anew in relational form (long tables, ``NOT EXISTS``, band joins)
rather than following the array expressions of the jobs. Reference tables are inlined.
"""

from __future__ import annotations

from riskspark.functions import phi
from riskspark.plans.bindings import NOTE_TAILS, TAIL_SURVIVORS, note_text
from riskspark.sources import fixed_values as fv
from riskspark.sources.refdata import builtin_refdata

REF = builtin_refdata()


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else "NULL" if v is None else _q(str(v)) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def part_code(key: str) -> str:
    return f"('Z' || lpad(CAST({key} AS VARCHAR), CAST(greatest(5, length(CAST({key} AS VARCHAR))) AS INTEGER), '0'))"


# reference tables ------------------------------------------------------------------------

DOMAIN = _values([(h, int(h[3:]), i) for i, h in enumerate(REF.domain)], "hcc, cc, pos", "domain")
HIER = _values([(h, x) for h, below in REF.hierarchy for x in below if x in REF.domain], "hcc, suppressed", "hier")
GROUPS = _values([(g, h, i) for i, (g, hs) in enumerate(REF.groups) for h in hs], "category, hcc, ord", "grps")
INTER = _values([(n, a, b, i) for i, (n, a, b) in enumerate(REF.interactions)], "interaction, var_1, var_2, ord", "inter")
FACTORS = (
    _values([(v, m, str(c)) for v, by in REF.factors.items() for m, c in by.items()], "variable, model, c", "factors0")
    + ",\nfactors AS (SELECT variable, model, CAST(c AS DECIMAL(12,3)) AS coef FROM factors0)"
)
MODELS = _values([(m, i) for i, m in enumerate(REF.models)], "model, ord", "models")
LABELS = _values(list(REF.labels.items()), "variable, label", "labels0")


def _bands(lows: list[int], name: str) -> str:
    rows = []
    for i, low in enumerate(lows):
        high = lows[i + 1] - 1 if i + 1 < len(lows) else None
        rows.append((low, 9999 if high is None else high, f"{low}_GT" if high is None else str(low) if high == low else f"{low}_{high}"))
    return _values(rows, "lo, hi, suffix", name)


CODEMAP = f"""codemap AS (
  SELECT {part_code('p_partkey')} AS icd10, d.cc,
    CASE WHEN p_size % 7 = 0 THEN 'age >= 18 and age < 90' END AS mce_rule,
    CASE p_size % 10 WHEN 0 THEN 'age >= 65' WHEN 1 THEN 'age < 65' WHEN 2 THEN 'age 50+' WHEN 3 THEN 'age == 18'
      WHEN 4 THEN '(age >= 12 and age <= 55)' WHEN 5 THEN '(age < 30) or (age > 60)' WHEN 6 THEN 'age >= 18 and (age < 80)'
      WHEN 7 THEN 'not age >= 70' WHEN 8 THEN 'not (age > 40 or (age < 20))' END AS age_rule,
    CASE p_size % 9 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'N/A' END AS sex_rule
  FROM part JOIN domain d ON d.pos = p_partkey % 89)"""

CUSTOMER_MEMBERS = """SELECT c_custkey AS member_id, DATE '1920-01-01' + CAST((c_custkey * 7919) % 32000 AS INTEGER) AS dob,
    CAST(1 + c_custkey % 2 AS INTEGER) AS sex, CAST((c_custkey // 2) % 4 AS INTEGER) AS orec, c_nationkey % 3 AS dual_status,
    CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS ltimcaid, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS nemcaid
  FROM customer"""

ORDER_DX = f"""SELECT o_custkey AS member_id, {part_code('l_partkey')} AS icd10, CAST(l_shipdate AS DATE) AS service_date
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def member_ctes(members: str = CUSTOMER_MEMBERS) -> list[str]:
    return [
        _bands(fv.CE_AGE_BANDS, "ce_bands"),
        _bands(fv.NE_AGE_BANDS, "ne_bands"),
        f"m0 AS ({members})",
        "m1 AS (SELECT *, CAST(date_sub('year', CAST(dob AS DATE), DATE '2027-02-01') AS INTEGER) AS age FROM m0)",
        """m2 AS (SELECT *, CASE WHEN age < 65 AND orec BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS disabl,
          CASE WHEN age >= 65 AND orec = 1 THEN 1 ELSE 0 END AS ne_origdis FROM m1)""",
        """m3 AS (SELECT *, CASE WHEN orec = 1 AND disabl = 0 THEN 1 ELSE 0 END AS origdis,
          CASE WHEN nemcaid = 0 AND ne_origdis = 0 THEN 'NMCAID_NORIGDIS' WHEN nemcaid = 1 AND ne_origdis = 0 THEN 'MCAID_NORIGDIS'
               WHEN nemcaid = 0 THEN 'NMCAID_ORIGDIS' ELSE 'MCAID_ORIGDIS' END AS ne_status,
          CASE WHEN age = 64 AND orec = 0 THEN 65 ELSE age END AS ne_age FROM m2)""",
        """mf AS (SELECT m3.*, CASE WHEN sex = 1 THEN 'M' ELSE 'F' END || c.suffix AS ce_cell,
          'NE' || CASE WHEN sex = 1 THEN 'M' ELSE 'F' END || n.suffix AS ne_cell,
          CASE WHEN origdis = 1 THEN CASE sex WHEN 2 THEN 'OriginallyDisabled_Female' WHEN 1 THEN 'OriginallyDisabled_Male' END END AS originally_disabled,
          CASE WHEN sex = 1 THEN 'Male' ELSE 'Female' END AS sex_label,
          CASE orec WHEN 0 THEN 'Aged/OASI' WHEN 1 THEN 'Disabled/DIB' WHEN 2 THEN 'ESRD' WHEN 3 THEN 'DIB+ESRD' ELSE 'Unknown' END AS orec_label,
          CASE WHEN ltimcaid = 1 THEN 'INSTITUTIONAL'
               ELSE 'COMMUNITY_' || CASE dual_status WHEN 2 THEN 'FB' WHEN 1 THEN 'PB' ELSE 'N' END || CASE WHEN age >= 65 THEN 'A' ELSE 'D' END END AS applicable_model
          FROM m3 LEFT JOIN ce_bands c ON age BETWEEN c.lo AND c.hi LEFT JOIN ne_bands n ON ne_age BETWEEN n.lo AND n.hi)""",
    ]


def _rule(column: str) -> str:
    return f"""CASE {column} WHEN 'age >= 65' THEN age >= 65 WHEN 'age < 65' THEN age < 65 WHEN 'age 50+' THEN age >= 50
      WHEN 'age >= 18 and age < 90' THEN age >= 18 AND age < 90 WHEN '(age >= 12 and age <= 55)' THEN age BETWEEN 12 AND 55
      WHEN '(age < 30) or (age > 60)' THEN age < 30 OR age > 60 WHEN 'age >= 18 and (age < 80)' THEN age BETWEEN 18 AND 79
      WHEN 'not age >= 70' THEN age < 70 WHEN 'not (age > 40 or (age < 20))' THEN age BETWEEN 20 AND 40 ELSE TRUE END"""


SEX_OK = "CASE WHEN sex_rule IN ('1', '2') THEN CAST(sex_rule AS INTEGER) = sex ELSE TRUE END"


def score_ctes(members: str = CUSTOMER_MEMBERS, dx: str = ORDER_DX, suffix: str = "") -> list[str]:
    """From members and diagnoses to ``wide`` (one row per member) and the long steps."""
    s = suffix
    ctes = [] if s else [DOMAIN, HIER, GROUPS, INTER, FACTORS, MODELS, LABELS, CODEMAP, *member_ctes(members)]
    return ctes + [
        f"dx{s} AS ({dx})",
        f"""mapped{s} AS (SELECT member_id, icd10, cc, mce_rule, age_rule, sex_rule, {_rule('mce_rule')} AS mce_ok,
          {_rule('age_rule')} AS age_ok, {SEX_OK} AS sex_ok FROM dx{s} JOIN codemap USING (icd10) JOIN mf USING (member_id))""",
        f"surv{s} AS (SELECT * FROM mapped{s} WHERE mce_ok AND age_ok AND sex_ok)",
        f"flags{s} AS (SELECT DISTINCT member_id, hcc FROM surv{s} JOIN domain USING (cc))",
        f"""act{s} AS (SELECT member_id, hcc FROM flags{s} f WHERE NOT EXISTS (
          SELECT 1 FROM flags{s} g JOIN hier h ON h.hcc = g.hcc WHERE g.member_id = f.member_id AND h.suppressed = f.hcc))""",
        f"grp{s} AS (SELECT DISTINCT member_id, category, ord FROM act{s} JOIN grps USING (hcc))",
        f"""feat0{s} AS (SELECT member_id, ce_cell AS variable, 1 AS v FROM mf WHERE ce_cell IS NOT NULL
          UNION ALL SELECT member_id, ne_status || '_' || ne_cell, 1 FROM mf WHERE ne_cell IS NOT NULL
          UNION ALL SELECT member_id, originally_disabled, 1 FROM mf WHERE originally_disabled IS NOT NULL
          UNION ALL SELECT member_id, 'DISABL', 1 FROM mf WHERE disabl = 1
          UNION ALL SELECT member_id, unnest(['ORIGDIS', 'ORIGDS']), 1 FROM mf WHERE origdis = 1
          UNION ALL SELECT member_id, hcc, 1 FROM act{s} UNION ALL SELECT member_id, category, 1 FROM grp{s})""",
        f"""itx{s} AS (SELECT a.member_id, i.interaction, i.ord FROM inter i JOIN feat0{s} a ON a.variable = i.var_1
          JOIN feat0{s} b ON b.member_id = a.member_id AND b.variable = i.var_2)""",
        f"""feat{s} AS (SELECT * FROM feat0{s} UNION ALL SELECT member_id, interaction, 1 FROM itx{s}
          UNION ALL SELECT member_id, 'LTIMCAID', ltimcaid FROM mf WHERE ltimcaid <> 0)""",
        f"sums{s} AS (SELECT member_id, model, sum(v * coef) AS total FROM feat{s} JOIN factors USING (variable) GROUP BY ALL)",
        f"""long{s} AS (SELECT mf.member_id, models.model, models.ord, applicable_model, CAST(coalesce(total, 0) AS DOUBLE) AS score
          FROM mf CROSS JOIN models LEFT JOIN sums{s} ON sums{s}.member_id = mf.member_id AND sums{s}.model = models.model)""",
    ]


HCC_LIST = "SELECT member_id, string_agg(hcc, ' ' ORDER BY cc) AS hccs FROM act JOIN domain USING (hcc) GROUP BY 1"
GROUP_LIST = "SELECT member_id, string_agg(category, ' ' ORDER BY ord) AS cats FROM grp GROUP BY 1"
INTER_LIST = "SELECT member_id, string_agg(interaction, ' ' ORDER BY ord) AS inters FROM itx GROUP BY 1"
LISTS = [f"hl AS ({HCC_LIST})", f"gl AS ({GROUP_LIST})", f"il AS ({INTER_LIST})"]

# text ------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}')"
GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"


def tfidf_ctes(corpus: str, queries: str, k: int) -> list[str]:
    """``corpus`` gives (doc, text), ``queries`` gives (qtext); result ``hits``."""
    return [
        f"corp AS ({corpus})",
        f"cg AS (SELECT doc, unnest({GRAMS}) AS term FROM (SELECT doc, {TOKENS.format(t='text')} AS t FROM corp))",
        "ctf AS (SELECT doc, term, count(*) AS tf FROM cg GROUP BY ALL)",
        "idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM corp)) / (1 + count(*))) + 1 AS idf FROM ctf GROUP BY 1)",
        "cw AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM ctf JOIN idf USING (term))",
        "cn AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM cw GROUP BY 1)",
        f"qs AS ({queries})",
        f"qg AS (SELECT qtext, unnest({GRAMS}) AS term FROM (SELECT qtext, {TOKENS.format(t='qtext')} AS t FROM (SELECT DISTINCT qtext FROM qs)))",
        "qtf AS (SELECT qtext, term, count(*) AS tf FROM qg GROUP BY ALL)",
        "qw AS (SELECT qtext, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term))",
        "qn AS (SELECT qtext, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1)",
        """sims AS (SELECT qtext, doc, round(sum(qw.w * cw.w / qn.norm / cn.norm), 9) AS sim FROM qw JOIN cw USING (term)
          JOIN qn USING (qtext) JOIN cn USING (doc) GROUP BY 1, 2)""",
        f"""hits AS (SELECT qtext, doc, round(sim, 3) AS similarity, CAST(row_number() OVER (PARTITION BY qtext ORDER BY sim DESC, doc) AS INTEGER) AS rank
          FROM sims WHERE sim > 0 QUALIFY rank <= {k})""",
    ]


CORPUS_ROWS = f"""SELECT {part_code('p_partkey')} AS icd10, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS description,
    coalesce(CAST(d.cc AS VARCHAR), '') AS cc, p_partkey AS load_order FROM part LEFT JOIN domain d ON d.pos = p_partkey % 89"""

CONDITIONS = """SELECT p_partkey AS note_id, 1 AS ord, p_name AS condition, p_name || ' ' || lower(p_type) AS search_query FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT p_partkey, 2, lower(p_type), '' FROM part WHERE p_partkey % 11 <> 0"""
QUERY_TEXTS = "SELECT note_id, ord, condition, CASE WHEN search_query = '' THEN condition ELSE search_query END AS qtext FROM conds"


def pool_ctes(k: int, conditions: str = CONDITIONS) -> list[str]:
    return [
        f"codes AS ({CORPUS_ROWS})",
        f"conds AS ({conditions})",
        *tfidf_ctes("SELECT icd10 AS doc, description AS text FROM codes", QUERY_TEXTS, k),
        """found AS (SELECT note_id, ord, condition, rank, doc AS icd10, similarity,
          row_number() OVER (PARTITION BY note_id, doc ORDER BY ord, rank) AS seen FROM qs JOIN hits USING (qtext))""",
        """pool AS (SELECT note_id, icd10, ord, rank, similarity, condition AS for_condition,
          CAST(row_number() OVER (PARTITION BY note_id ORDER BY ord, rank) AS INTEGER) AS position FROM found WHERE seen = 1)""",
        """selected AS (SELECT note_id, position AS pos, icd10, description, cc, for_condition AS condition,
          CASE WHEN note_id % 5 <> 0 THEN 1 - position / 10 END AS confidence, CASE WHEN note_id % 5 = 0 THEN similarity END AS similarity
          FROM pool JOIN codes USING (icd10) WHERE position <= CASE WHEN note_id % 5 = 0 THEN 5 ELSE 3 END)""",
    ]


# identifiers -----------------------------------------------------------------------------

NOTES = f"SELECT doc_id AS note_id, {note_text()} AS text FROM documents"
NAME_PATTERNS = {
    "LOCATION": r"(?i)\bnation_(?:1\d|2[0-4]|\d)\b",
    "MEDICAL_LICENSE": r"(?i)\bsupplier[^\p{L}\p{N}_]+00000000\d\b",
    "PERSON": r"(?i)\bcustomer[^\p{L}\p{N}_]+0000000\d\d\b",
}


def _sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def deid_ctes(source: str, key: str = "note_id") -> list[str]:
    """``source`` gives (key, text); result ``deid`` with s (text) and one count per type."""
    passes = [*phi.PATTERNS.items(), *[(t, NAME_PATTERNS[t]) for t in phi.GAZETTEER_TYPES], ("MRN", fv.MRN_PATTERN)]
    ctes = [f"d0 AS (SELECT *, text AS s FROM ({source}))"]
    for i, (entity, pattern) in enumerate(passes):
        p = _sql_regex(pattern)
        label = f"MRN [REDACTED_MRN_1]" if entity == "MRN" else f"[REDACTED_{entity}_1]"
        ctes.append(
            f"d{i + 1} AS (SELECT * REPLACE (regexp_replace(s, {p}, '{label}', 'g') AS s), len(regexp_extract_all(s, {p})) AS n_{entity} FROM d{i})"
        )
    return ctes + [f"deid AS (SELECT * FROM d{len(passes)})"]


ALL_TYPES = [*phi.PATTERNS, *phi.GAZETTEER_TYPES, "MRN"]
UNNUMBERED = r"md5(regexp_replace(s, '_\d+\]', ']', 'g'))"
ANY_FOUND = "(" + " + ".join(f"n_{t}" for t in ALL_TYPES) + ") > 0"
FINDINGS = " UNION ALL ".join(f"SELECT note_id, '{t}' AS entity_type, CAST(n_{t} AS INTEGER) AS count FROM deid WHERE n_{t} > 0" for t in ALL_TYPES)

_U = r"\p{L}\p{N}_"
RAW_IDS = f"""list_concat(list_concat(list_concat(regexp_extract_all({{t}}, '\\b\\d{{{{3}}}}-\\d{{{{2}}}}-\\d{{{{4}}}}\\b'),
    regexp_extract_all({{t}}, '\\b\\d{{{{3}}}}-\\d{{{{3}}}}-\\d{{{{4}}}}\\b')),
    regexp_extract_all({{t}}, '[{_U.replace('{', '{{').replace('}', '}}')}.+-]+@[{_U.replace('{', '{{').replace('}', '}}')}-]+\\.[{_U.replace('{', '{{').replace('}', '}}')}.-]*[{_U.replace('{', '{{').replace('}', '}}')}]')),
    regexp_extract_all({{t}}, '(?i)MRN[:#]?\\s*([A-Za-z0-9\\-]{{{{4,}}}})', 1))"""

KEYWORD_HITS = "(" + " + ".join(f"CAST(contains(lower({{t}}), {_q(w)}) AS INTEGER)" for w in fv.CLINICAL_KEYWORDS) + ")"

STRIPPED = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
PHI_EXPECTED = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN [{', '.join(_q(t) for t in types)}]" for k, (_, types) in NOTE_TAILS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
PHI_TAILS = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN [{', '.join(_q(t) for t in words)}]" for k, words in TAIL_SURVIVORS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
PHI_SOURCE = f"""SELECT doc_id AS note_id, {note_text()} AS text, {PHI_EXPECTED} AS expected,
    list_concat(list_concat(w[1:2], w[greatest(1, len(w) - 1):len(w)]), {PHI_TAILS}) AS must_survive
  FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}{{4,}}') AS w FROM documents)"""
FOUND_LIST = "list_filter([" + ", ".join(f"CASE WHEN n_{t} > 0 THEN '{t}' END" for t in ALL_TYPES) + "], lambda x: x IS NOT NULL)"
_MINUS = "list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
PHI_ROWS = f"""SELECT note_id, array_to_string(list_sort(expected), ' ') AS expected_entities, array_to_string(list_sort(found), ' ') AS found_entities,
    array_to_string({_MINUS.format(a='expected', b='found')}, ' ') AS missed, array_to_string({_MINUS.format(a='found', b='expected')}, ' ') AS extra,
    CAST(len(list_filter(expected, lambda x: list_contains(found, x))) AS INTEGER) AS tp, CAST(len({_MINUS.format(a='found', b='expected')}) AS INTEGER) AS fp,
    CAST(len({_MINUS.format(a='expected', b='found')}) AS INTEGER) AS fn, CAST(len(must_survive) AS INTEGER) AS n_terms,
    CAST(len(list_filter(must_survive, lambda w: contains(lower(s), lower(w)))) AS INTEGER) AS n_survived,
    array_to_string(list_filter(must_survive, lambda w: NOT contains(lower(s), lower(w))), ' ') AS corrupted
  FROM (SELECT *, {FOUND_LIST} AS found FROM deid)"""
PHI_CTES = [*deid_ctes(PHI_SOURCE), f"phi_rows AS ({PHI_ROWS})"]

AUDIT = [
    f"""records AS (SELECT note_id AS record_id, CASE WHEN note_id % 2 = 0 THEN {RAW_IDS.format(t='text')} ELSE CAST([] AS VARCHAR[]) END AS ids,
      'Identified ICD-10 codes: Z' || note_id || '.' || CASE WHEN note_id % 3 = 0 THEN ' ' || upper(text) ELSE '' END AS output FROM ({NOTES}))""",
    "leaky AS (SELECT record_id, list_filter(ids, lambda v: contains(lower(output), lower(v))) AS leaked FROM records)",
]
TOXIC_LIST = "list_filter([" + ", ".join(_q(t) for t in fv.TOXIC_TERMS) + "], lambda t: contains(lower(output), t))"
TOXIC = [
    f"""toxic AS (SELECT record_id, {TOXIC_LIST} AS terms FROM (SELECT doc_id AS record_id,
      coalesce(text || CASE WHEN toxic = 1 THEN ' how stupid, I HATE it' ELSE '' END, '') AS output FROM documents LEFT JOIN labels USING (doc_id)))"""
]


def _rate(source: str, column: str, name: str) -> str:
    return f"""SELECT count(*) AS n_records, count(*) FILTER (len({column}) > 0) AS n_hits,
      coalesce(round(count(*) FILTER (len({column}) > 0) / count(*), 3), 0.0) AS {name} FROM {source}"""


# retrieval evaluation --------------------------------------------------------------------

RETRIEVAL = [
    """gold AS (SELECT item_id AS case_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)
      UNION ALL SELECT item_id, -1 - item_id FROM benchmark WHERE item_id % 3 = 0)""",
    *tfidf_ctes(
        "SELECT doc_id AS doc, text FROM documents",
        "SELECT item_id AS case_id, 1 AS ord, text AS qtext FROM benchmark UNION ALL SELECT item_id, 2, left(text, 40) FROM benchmark",
        10,
    ),
    "rfound AS (SELECT case_id, doc, ord, rank, similarity FROM qs JOIN hits USING (qtext) QUALIFY row_number() OVER (PARTITION BY case_id, doc ORDER BY ord, rank) = 1)",
    "rpool AS (SELECT case_id, doc, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, ord, rank) AS place FROM rfound)",
    """per_case AS (SELECT case_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(round(1 / first_place, 3), 0.0) AS mrr,
        coalesce(round(coalesce(h6, 0) / n_gold, 3), 1.0) AS recall_6, coalesce(round(coalesce(h10, 0) / n_gold, 3), 1.0) AS recall_10,
        coalesce(round(coalesce(hit, 0) / n_retrieved, 3), 0.0) AS precision_pool, coalesce(n_gold, 0) - coalesce(hit, 0) AS n_missing
      FROM (SELECT item_id AS case_id FROM benchmark) LEFT JOIN (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS n_retrieved FROM rpool GROUP BY 1) USING (case_id)
      LEFT JOIN (SELECT case_id, min(place) AS first_place, count(*) AS hit, count(*) FILTER (place <= 6) AS h6, count(*) FILTER (place <= 10) AS h10
                 FROM rpool JOIN gold USING (case_id, doc) GROUP BY 1) USING (case_id))""",
]

# providers -------------------------------------------------------------------------------

PROVIDER_BASE = [
    f"plines AS (SELECT l_orderkey AS case_id, {part_code('l_partkey')} AS icd10, l_returnflag, l_linenumber, l_quantity FROM lineitem)",
    """pred AS (SELECT case_id, 'alpha' AS provider, icd10, l_linenumber, l_quantity FROM plines WHERE l_returnflag IN ('A', 'N')
      UNION ALL SELECT case_id, 'beta', icd10, l_linenumber, l_quantity FROM plines WHERE l_returnflag IN ('N', 'R'))""",
    "runs AS (SELECT o_orderkey AS case_id, provider FROM orders CROSS JOIN (VALUES ('alpha'), ('beta')) v(provider))",
    "pgold AS (SELECT DISTINCT case_id, icd10 FROM plines WHERE l_linenumber <> 2 AND case_id % 7 <> 0)",
    "gcount AS (SELECT case_id, count(*) AS ng FROM pgold GROUP BY 1)",
    """pcount AS (SELECT p.case_id, p.provider, count(*) AS np, count(g.icd10) AS tp FROM (SELECT DISTINCT case_id, provider, icd10 FROM pred) p
      LEFT JOIN pgold g ON g.case_id = p.case_id AND g.icd10 = p.icd10 GROUP BY ALL)""",
    """parts AS (SELECT case_id, provider, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN coalesce(tp, 0) / ng ELSE 1.0 END AS r
      FROM runs LEFT JOIN pcount USING (case_id, provider) LEFT JOIN gcount USING (case_id))""",
    """prf AS (SELECT case_id, provider, round(p, 3) AS code_precision, round(r, 3) AS code_recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 3) AS code_f1 FROM parts)""",
    """lat AS (SELECT case_id, provider, round(sum(s), 3) AS latency_total FROM (
      SELECT case_id, provider, l_linenumber % 2 AS step, round(sum(l_quantity / 10), 3) AS s FROM pred GROUP BY ALL) GROUP BY ALL)""",
    "plist AS (SELECT case_id, provider, string_agg(DISTINCT icd10, ' ' ORDER BY icd10) AS codes FROM pred GROUP BY ALL)",
]
PROVIDER_SCORES = [
    *score_ctes(
        f"SELECT (case_id || '/' || provider) AS member_id, * EXCLUDE (member_id) FROM runs JOIN orders ON o_orderkey = case_id JOIN ({CUSTOMER_MEMBERS}) c ON c.member_id = o_custkey",
        "SELECT (case_id || '/' || provider) AS member_id, icd10 FROM pred",
    ),
    f"hl AS ({HCC_LIST})",
    """pscore AS (SELECT case_id, provider, coalesce(hccs, '') AS hccs, score FROM mf JOIN long ON long.member_id = mf.member_id AND long.model = mf.applicable_model
      LEFT JOIN hl ON hl.member_id = mf.member_id)""",
    """prow AS (SELECT case_id, provider, code_precision, code_recall, code_f1, latency_total, coalesce(codes, '') AS codes, hccs, score
      FROM prf LEFT JOIN lat USING (case_id, provider) LEFT JOIN plist USING (case_id, provider) JOIN pscore USING (case_id, provider))""",
    "ptotal AS (SELECT provider, count(*) AS n_cases, round(avg(code_f1), 3) AS mean_f1, round(avg(latency_total), 3) AS mean_latency FROM prow GROUP BY 1)",
]


def _side(p: str) -> str:
    return ", ".join(f"max(CASE WHEN provider = '{p}' THEN {c} END) AS {c}_{p}" for c in ("codes", "hccs", "score", "code_f1", "latency_total"))


# notes to scores -------------------------------------------------------------------------

NOTE_MEMBERS = CUSTOMER_MEMBERS.replace("c_custkey AS member_id", "c_custkey AS member_id, c_custkey AS note_id")


def note_score_ctes(codes: str) -> list[str]:
    """Scores of the notes that have selected codes and demographics."""
    members = f"SELECT * FROM ({NOTE_MEMBERS}) WHERE note_id IN (SELECT note_id FROM ({codes}))"
    return score_ctes(members, f"SELECT note_id AS member_id, icd10 FROM ({codes})")


CE_TEXT = "(SELECT member_id, '{' || string_agg('''' || model || ''': ' || CAST(score AS VARCHAR), ', ' ORDER BY ord) || '}' AS ce FROM long WHERE ord < 7 GROUP BY 1)"


def all_sql() -> dict[str, str]:
    score = score_ctes()
    sql: dict[str, str] = {}
    add = sql.__setitem__

    # reference tables and sources
    add("ref_factors_long", _with(*score, select="""SELECT variable, model, CAST(coef AS DOUBLE) AS coef, coalesce(n, 0) AS n_members
      FROM factors LEFT JOIN (SELECT variable, count(*) AS n FROM feat WHERE variable <> 'LTIMCAID' GROUP BY 1) USING (variable)"""))
    add("ref_hierarchy_long", _with(*score, select="""SELECT h.hcc, h.suppressed, count(g.member_id) AS n_members FROM hier h
      LEFT JOIN (flags f JOIN flags g USING (member_id)) ON f.hcc = h.hcc AND g.hcc = h.suppressed GROUP BY ALL"""))
    add("dx_map", _with(DOMAIN, CODEMAP, select="""SELECT icd10, cc, mce_rule, age_rule, sex_rule,
      CASE WHEN sex_rule IN ('1', '2') THEN CAST(sex_rule AS INTEGER) END AS sex_edit FROM codemap"""))
    add("code_files", _with(DOMAIN, f"codes AS ({CORPUS_ROWS})", select="SELECT icd10, description, cc FROM codes"))
    add("code_corpus", _with(DOMAIN, f"codes AS ({CORPUS_ROWS})", select="SELECT * FROM codes"))
    body = """'{"id":"case-' || item_id || '","note":' || CAST(to_json(text) AS VARCHAR) || ',"search_queries":[' || CAST(to_json(text) AS VARCHAR) || '],"expected_icd10":["Z' || item_id || '"]}'"""
    add("eval_cases", f"""SELECT CASE WHEN item_id % 13 = 0 THEN '' ELSE 'case-' || item_id END AS id,
      CASE WHEN item_id % 13 = 0 THEN md5(left(body, length(body) - 3)) ELSE md5(text) END AS note_md5,
      CASE WHEN item_id % 13 = 0 THEN '' ELSE 'Z' || item_id END AS expected_icd10, item_id % 13 = 0 AS quarantined
      FROM (SELECT item_id, text, {body} AS body FROM benchmark)""")

    # members and diagnoses
    members = member_ctes()
    add("member_features", _with(*members, select="""SELECT member_id, CAST(dob AS DATE) AS dob, age, sex, orec, disabl, origdis, ce_cell,
      originally_disabled, sex_label, orec_label FROM mf"""))
    add("ne_features", _with(*members, select="SELECT member_id, ne_origdis, ne_cell, ne_status, ne_status || '_' || ne_cell AS ne_variable FROM mf"))
    add("applicable_model", _with(*members, select="SELECT member_id, applicable_model FROM mf"))
    add("dx_normalized", _with(f"dx AS ({ORDER_DX})", select="SELECT * FROM dx"))
    count = lambda cond: f"count(*) FILTER ({cond})"
    add("dx_edits", _with(*score, select=f"""SELECT mce_rule, age_rule, sex_rule, count(*) AS n_rows, {count('NOT mce_ok')} AS n_mce_dropped,
      {count('mce_ok AND NOT age_ok')} AS n_age_dropped, {count('mce_ok AND age_ok AND NOT sex_ok')} AS n_sex_dropped,
      {count('mce_ok AND age_ok AND sex_ok')} AS n_kept, coalesce(age_rule = 'age == 18', FALSE) AS fails_open FROM mapped GROUP BY ALL"""))
    add("icd10_to_cc", _with(*score, select="SELECT member_id, icd10, cc, count(*) AS n FROM surv GROUP BY ALL"))
    add("cc_flags", _with(*score, select="SELECT * FROM flags"))
    add("hierarchies", _with(*score, select="SELECT * FROM act"))
    add("diag_categories", _with(*score, select="SELECT member_id, category FROM grp"))
    add("interactions", _with(*score, select="SELECT member_id, interaction FROM itx"))

    # scores
    applies = "SELECT member_id, model, score, model = applicable_model AS applicable FROM long"
    add("ce_scores", _with(*score, select=f"{applies} WHERE ord < 7"))
    add("ne_scores", _with(*score, select=f"{applies} WHERE ord >= 7"))
    add("all_scores", _with(*score, select="SELECT member_id, model, score FROM long"))
    add("scores_from_folder", _with(*score, select="SELECT member_id, model, CAST(CAST(score AS DECIMAL(12,3)) * 2 AS DOUBLE) AS score FROM long"))
    joined = "FROM mf LEFT JOIN hl USING (member_id) LEFT JOIN gl USING (member_id) LEFT JOIN il USING (member_id)"
    lists = "coalesce(cats, '') AS {a}, coalesce(inters, '') AS interactions"
    add("active_hccs", _with(*score, *LISTS, "ll AS (SELECT member_id, string_agg(label, '; ' ORDER BY cc) AS labels FROM act JOIN domain USING (hcc) JOIN labels0 ON variable = hcc GROUP BY 1)",
        select=f"SELECT member_id, coalesce(hccs, '') AS hccs, coalesce(labels, '') AS labels, {lists.format(a='categories')} {joined} LEFT JOIN ll USING (member_id)"))
    wide = ", ".join(f"max(score) FILTER (model = '{m}') AS {m}" for m in REF.models)
    result = f"""SELECT member_id, age, sex_label, orec_label, disabl, origdis, coalesce(hccs, '') AS active_hccs, {lists.format(a='diag_categories')},
      {', '.join(REF.models)}, applicable_model, applicable_score {joined}
      JOIN (SELECT member_id, {wide}, max(score) FILTER (model = applicable_model) AS applicable_score FROM long GROUP BY 1) USING (member_id)"""
    add("member_result", _with(*score, *LISTS, select=result))
    add("stream_rescore", _with(*score, *LISTS, select=result + " WHERE member_id IN (SELECT member_id FROM dx)"))
    label_case = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in fv.MODEL_LABELS.items())
    add("score_card", _with(*score, select=f"""SELECT member_id, model, CASE model {label_case} END AS label, score,
      CASE WHEN score < 0.7 THEN 'low' WHEN score < 1.8 THEN 'mid' ELSE 'high' END AS tier,
      CASE WHEN score >= 1 THEN '+' ELSE '' END || CAST(CAST(CAST(score AS DECIMAL(12,3)) * 100 - 100 AS DECIMAL(12,1)) AS VARCHAR) || '% vs avg' AS versus_average,
      model = applicable_model AS applicable FROM long"""))
    add("suppression_audit", _with(*score, select="""SELECT f.member_id, h.suppressed, h.hcc AS suppressed_by FROM hier h JOIN flags f ON f.hcc = h.hcc
      JOIN flags g ON g.member_id = f.member_id AND g.hcc = h.suppressed"""))
    add("score_contributions", _with(*score, select="""SELECT member_id, model, variable, coalesce(label, '') AS label, CAST(v * coef AS DOUBLE) AS contribution,
      CAST(row_number() OVER (PARTITION BY member_id ORDER BY v * coef DESC, variable) AS INTEGER) AS impact_rank
      FROM feat JOIN mf USING (member_id) JOIN factors USING (variable) LEFT JOIN labels0 USING (variable) WHERE model = applicable_model"""))
    added = f"SELECT member_id, icd10 FROM ({ORDER_DX}) UNION ALL SELECT c_custkey, {part_code('c_custkey')} FROM customer WHERE c_custkey % 3 = 0"
    add("what_if", _with(*score, *score_ctes(dx=added, suffix="2"), select="""SELECT a.member_id, a.model, a.score, b.score AS score_after,
      CAST(CAST(b.score AS DECIMAL(12,3)) - CAST(a.score AS DECIMAL(12,3)) AS DOUBLE) AS difference
      FROM long a JOIN long2 b USING (member_id, model) WHERE member_id % 3 = 0"""))

    wrong = " || ' ' || ".join(f"CASE WHEN member_id % {n} = 0 THEN '{c}' ELSE '' END" for n, c in ((11, "sex"), (13, "orec"), (17, "dual_status")))
    add("roster_intake", _with(*score, select=f"""SELECT member_id, reasons, CASE WHEN reasons = '' THEN applicable_model END AS applicable_model,
      CASE WHEN reasons = '' THEN score END AS applicable_score
      FROM (SELECT *, trim(replace({wrong}, '  ', ' ')) AS reasons FROM long WHERE model = applicable_model)"""))

    # retrieval
    add("tokenize", f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(t='text')}) AS token FROM documents) GROUP BY ALL")
    add("ngrams", f"""SELECT ngram, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (
      SELECT doc_id, unnest({GRAMS}) AS ngram FROM (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents)) GROUP BY 1""")
    documents = tfidf_ctes("SELECT doc_id AS doc, text FROM documents", "SELECT '' AS qtext", 1)[:6]
    add("tfidf_index", _with(*documents, select="""SELECT term, max(df) AS df, round(max(idf), 9) AS idf, count(DISTINCT md5(text)) AS n_postings,
      round(max(w / norm), 9) AS max_weight FROM cw JOIN idf i USING (term) JOIN cn USING (doc) JOIN corp USING (doc) GROUP BY 1""".replace("max(idf)", "max(i.idf)").replace("max(df)", "max(i.df)")))
    add("search_topk", _with(DOMAIN, *pool_ctes(10), select="SELECT note_id, ord, rank, doc AS icd10, similarity FROM qs JOIN hits USING (qtext)"))
    add("code_lookup", _with(DOMAIN, f"codes AS ({CORPUS_ROWS})", f"dx AS ({ORDER_DX})",
        select="SELECT icd10, description, cc FROM (SELECT DISTINCT icd10 FROM dx) LEFT JOIN codes USING (icd10)"))
    add("candidate_pool", _with(DOMAIN, *pool_ctes(6), select="SELECT * FROM pool"))
    add("retrieval_eval", _with(*RETRIEVAL, select="SELECT * FROM per_case"))
    add("retrieval_missing", _with(*RETRIEVAL, select="SELECT case_id, doc FROM gold WHERE (case_id, doc) NOT IN (SELECT (case_id, doc) FROM rpool)"))
    add("retrieval_means", _with(*RETRIEVAL, select="""SELECT count(*) AS n_cases, coalesce(round(avg(mrr), 3), 0.0) AS mrr,
      coalesce(round(avg(recall_6), 3), 0.0) AS recall_6, coalesce(round(avg(recall_10), 3), 0.0) AS recall_10 FROM per_case"""))

    # de-identification
    deid = deid_ctes(NOTES)
    add("deidentify", _with(*deid, select=f"SELECT note_id, {UNNUMBERED} AS text_md5, {ANY_FOUND} AS redacted, TRUE AS enabled FROM deid"))
    clinical = f"(length({STRIPPED.format(t='s')}) > 80 OR {KEYWORD_HITS.format(t='s')} >= 2)"
    add("stream_deid", _with(*deid, select=f"SELECT note_id, {UNNUMBERED} AS text_md5, {ANY_FOUND} AS redacted, {clinical} AS is_clinical FROM deid"))
    add("phi_findings", _with(*deid, select=FINDINGS))
    mrn = _sql_regex(fv.MRN_PATTERN)
    add("redact_mrn", f"""SELECT note_id, md5(regexp_replace(text, {mrn}, 'MRN [REDACTED_MRN_1]', 'g')) AS text_md5,
      CAST(len(regexp_extract_all(text, {mrn})) AS INTEGER) AS n_mrn FROM ({NOTES})""")
    add("extract_identifiers", f"""SELECT note_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos, unnest(ids) AS identifier
      FROM (SELECT note_id, {RAW_IDS.format(t='text')} AS ids FROM ({NOTES}))""")
    add("phi_eval", _with(*PHI_CTES, select="SELECT * FROM phi_rows"))
    f1 = "CASE WHEN entity_precision + entity_recall > 0 THEN round(2 * entity_precision * entity_recall / (entity_precision + entity_recall), 3) ELSE 0.0 END"
    add("phi_means", _with(*PHI_CTES, select=f"""SELECT *, {f1} AS entity_f1 FROM (SELECT count(*) AS n_cases,
      CASE WHEN sum(tp + fp) > 0 THEN round(sum(tp) / sum(tp + fp), 3) ELSE 1.0 END AS entity_precision,
      CASE WHEN sum(tp + fn) > 0 THEN round(sum(tp) / sum(tp + fn), 3) ELSE 1.0 END AS entity_recall,
      CASE WHEN sum(n_terms) > 0 THEN round(sum(n_survived) / sum(n_terms), 3) ELSE 1.0 END AS clinical_survival_rate FROM phi_rows)"""))
    add("leak_audit", _with(*AUDIT, select="SELECT record_id, CAST(generate_subscripts(leaked, 1) - 1 AS INTEGER) AS pos, unnest(leaked) AS leaked FROM leaky"))
    add("leak_rate", _with(*AUDIT, select=_rate("leaky", "leaked", "leak_rate")))
    add("toxicity_audit", _with(*TOXIC, select="SELECT record_id, array_to_string(terms, ', ') AS terms FROM toxic WHERE len(terms) > 0"))
    add("toxicity_rate", _with(*TOXIC, select=_rate("toxic", "terms", "hit_rate")))

    # note steps
    add("clinical_gate", f"""SELECT doc_id, {KEYWORD_HITS.format(t='t')} AS keyword_hits, length({STRIPPED.format(t='t')}) > 80 OR {KEYWORD_HITS.format(t='t')} >= 2 AS is_clinical,
      trim(t, E' \\t\\n\\r') = '' AS rejected FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Patient history' ELSE '' END AS t FROM documents
      UNION ALL SELECT -1 - doc_id, repeat(' ', 10) || repeat('x', 70) || repeat(' ', 20) FROM documents WHERE doc_id % 5 = 0)""")
    add("parse_completions", f"""SELECT note_id, CAST(ord AS INTEGER) AS ord, condition, search_query, FALSE AS quarantined FROM ({CONDITIONS})
      UNION ALL SELECT p_partkey, 0, NULL, NULL, TRUE FROM part WHERE p_partkey % 11 = 0""")
    add("selection_intake", """SELECT p_partkey AS note_id, p_partkey % 6 <> 5 AS ok, CAST(CASE p_partkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS n_bad,
      CASE p_partkey % 6 WHEN 0 THEN c || ' ' || c WHEN 1 THEN c WHEN 3 THEN c ELSE '' END AS codes, CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
      FROM (SELECT *, 'Z' || p_partkey || '/' || p_size AS c FROM part)""")
    add("provider_routing", """SELECT event_id AS note_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN event_type ELSE 'click' END AS extract,
      CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'error' END AS select, 'click' AS explain FROM events""")
    columns = "note_id, pos, icd10, description, cc, condition, confidence, similarity"
    add("selected_codes", _with(DOMAIN, *pool_ctes(6), select=f"SELECT {columns} FROM selected"))
    add("code_card", _with(DOMAIN, *pool_ctes(6), select="""SELECT note_id, pos, icd10, description, 'CC' || cc AS cc, condition,
      CAST(floor(coalesce(confidence, similarity, 0) * 100 + 0.5) AS INTEGER) AS confidence_percent FROM selected"""))
    chosen = "SELECT * FROM selected"
    note_lists = """cl AS (SELECT note_id, string_agg(icd10, ' ' ORDER BY pos) AS codes,
      string_agg('''' || icd10 || ' (' || description || ', CC' || cc || ')''', ', ' ORDER BY pos) AS code_texts FROM selected GROUP BY 1)"""
    note_ctes = [c for c in [*note_score_ctes(chosen)] if c is not DOMAIN]
    scored_notes = "(SELECT mf.note_id, mf.member_id, mf.age, mf.applicable_model, score AS applicable_score FROM mf JOIN long ON long.member_id = mf.member_id AND model = mf.applicable_model)"
    add("member_summary", _with(DOMAIN, *pool_ctes(6), *note_ctes, *LISTS, note_lists, select=f"""SELECT note_id, '{fv.SUMMARY_CODES}' || replace(codes, ' ', ', ')
      || '{fv.SUMMARY_HCCS}' || replace(coalesce(hccs, ''), ' ', ', ') || '{fv.SUMMARY_MODEL}' || coalesce(applicable_model, 'None') || '{fv.SUMMARY_SCORE}'
      || coalesce(CAST(applicable_score AS VARCHAR), 'None') || '.' AS summary FROM cl LEFT JOIN {scored_notes} USING (note_id) LEFT JOIN hl USING (member_id)"""))
    gated = f"SELECT note_id FROM deid WHERE {clinical}"
    gated_conditions = f"SELECT * FROM ({CONDITIONS}) WHERE note_id IN ({gated})"
    add("note_to_score", _with(DOMAIN, *deid, *pool_ctes(6, gated_conditions), *note_ctes, *LISTS, select=f"""SELECT note_id, age, coalesce(hccs, '') AS hccs,
      applicable_model, applicable_score FROM {scored_notes} LEFT JOIN hl USING (member_id)"""))
    left_in = lambda c: f"array_to_string(list_filter(ids, lambda v: contains(lower({c}), lower(v))), ' | ')"
    add("pipeline_audit", _with(DOMAIN, *deid, *pool_ctes(6, gated_conditions), *note_ctes, *LISTS, note_lists, f"""said AS (SELECT note_id,
        '{fv.SUMMARY_CODES}' || replace(codes, ' ', ', ') || '{fv.SUMMARY_HCCS}' || replace(coalesce(hccs, ''), ' ', ', ') || '{fv.SUMMARY_MODEL}'
        || coalesce(applicable_model, 'None') || '{fv.SUMMARY_SCORE}' || coalesce(CAST(applicable_score AS VARCHAR), 'None') || '.' AS summary
        FROM cl LEFT JOIN {scored_notes} USING (note_id) LEFT JOIN hl USING (member_id))""",
        f"""held AS (SELECT note_id, {RAW_IDS.format(t='text')} AS ids, s, coalesce(summary, '') AS summary, s || chr(10) || coalesce(summary, '') AS output
        FROM deid LEFT JOIN said USING (note_id))""",
        select=f"""SELECT note_id, CAST(len(ids) AS INTEGER) AS n_identifiers, {left_in('s')} AS leaked_in_text, {left_in('summary')} AS leaked_in_summary,
        array_to_string({TOXIC_LIST}, ' | ') AS terms FROM held"""))
    quoted = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN '[]' ELSE '[''' || replace({c}, ' ', ''', ''') || ''']' END"
    def explained(notes: str) -> list[str]:
        """Prompts ``p`` of the notes (note_id, s) that the SQL text gives."""
        return [
            "nc AS (SELECT note_id, string_agg('''' || condition || '''', ', ' ORDER BY ord) AS names FROM conds GROUP BY 1)",
            f"""ctx AS (SELECT d.note_id, s, concat_ws(chr(10), '{fv.EXPLAIN_CONDITIONS}[' || names || ']', '{fv.EXPLAIN_CODES}[' || code_texts || ']',
              '{fv.EXPLAIN_HCCS}' || {quoted('hccs')} || chr(10) || '{fv.EXPLAIN_MODEL}' || applicable_model || chr(10) || '{fv.EXPLAIN_SCORE}' || CAST(applicable_score AS VARCHAR)
              || chr(10) || '{fv.EXPLAIN_CE_SCORES}' || ce || chr(10) || '{fv.EXPLAIN_INTERACTIONS}' || {quoted('inters')}) AS c
              FROM ({notes}) d LEFT JOIN nc ON nc.note_id = d.note_id LEFT JOIN cl ON cl.note_id = d.note_id
              LEFT JOIN {scored_notes} sn ON sn.note_id = d.note_id LEFT JOIN hl USING (member_id) LEFT JOIN il USING (member_id) LEFT JOIN {CE_TEXT} e USING (member_id))""",
            f"p AS (SELECT note_id, CASE WHEN c = '' THEN s ELSE s || chr(10) || chr(10) || '{fv.EXPLAIN_RESULTS}' || chr(10) || c END AS prompt FROM ctx)",
        ]

    gated_notes = f"SELECT * FROM deid WHERE {clinical} AND {STRIPPED.format(t='s')} <> ''"
    add("explain_prompts", _with(DOMAIN, *deid, *pool_ctes(6), *note_ctes, *LISTS, note_lists, *explained(gated_notes),
        select=f"SELECT note_id, {UNNUMBERED.replace('(s,', '(prompt,')} AS prompt_md5 FROM p"))
    own = f"SELECT note_id, 1 AS ord, CAST(NULL AS VARCHAR) AS condition, s AS search_query FROM ({gated_notes})"
    ending = f"""SELECT note_id, n.text || coalesce(' Assessment: ' || p_name || ' ' || lower(p_type), '') AS text
      FROM ({NOTES}) n LEFT JOIN part ON p_partkey = note_id"""
    add("note_as_query", _with(DOMAIN, *deid_ctes(ending), *pool_ctes(6, own), select="""SELECT note_id, position, icd10, similarity,
      coalesce(for_condition, '') AS for_condition FROM pool"""))
    add("select_prompts", _with(DOMAIN, *deid, *pool_ctes(6),
        """listed AS (SELECT note_id, count(*) AS n, '[' || string_agg('{"condition":"' || condition || '","search_query":"' || search_query || '"}', ',' ORDER BY ord) || ']' AS c
          FROM conds GROUP BY 1)""",
        """offered AS (SELECT note_id, count(*) AS n, '[' || string_agg('{"icd10":"' || icd10 || '","description":"' || description || '","cc":"' || cc || '","similarity":'
          || CAST(similarity AS VARCHAR) || ',"for_condition":"' || for_condition || '"}', ',' ORDER BY position) || ']' AS k FROM pool JOIN codes USING (icd10) WHERE position <= 25 GROUP BY 1)""",
        f"""p AS (SELECT d.note_id, offered.n AS n_candidates, listed.n AS n_conditions, '{fv.SELECT_NOTES}' || chr(10) || s || chr(10) || chr(10) || '{fv.SELECT_CONDITIONS}' || c
          || chr(10) || chr(10) || '{fv.SELECT_CANDIDATES}' || chr(10) || k AS prompt FROM deid d JOIN offered USING (note_id) JOIN listed USING (note_id)
          WHERE {clinical} AND {STRIPPED.format(t='s')} <> '')""",
        select=f"""SELECT note_id, {UNNUMBERED.replace('(s,', '(prompt,')} AS prompt_md5, CAST(n_candidates AS INTEGER) AS n_candidates,
          CAST(n_conditions AS INTEGER) AS n_conditions FROM p"""))
    add("pending_prompts", "SELECT doc_id AS note_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = doc_id AND p_partkey % 3 <> 0)")
    said = "SELECT conv_id * 1000000 + turn AS note_id, conv_id, turn, role, text FROM conversations"
    add("conversation_history", _with(*deid_ctes(said), select=f"""SELECT conv_id, turn, role,
      md5(regexp_replace(CASE WHEN role = 'user' THEN s ELSE text END, '_\\d+\\]', ']', 'g')) AS content_md5,
      count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS messages FROM deid"""))

    asked = """asked AS (SELECT conv_id, turn FROM conversations c WHERE role = 'user'
      AND NOT EXISTS (SELECT 1 FROM conversations l WHERE l.conv_id = c.conv_id AND l.turn > c.turn AND l.role IN ('user', 'assistant')))"""
    sent = f"""sent AS (SELECT conv_id AS note_id, turn, s, {clinical} AS is_clinical FROM deid JOIN asked USING (conv_id, turn)
      WHERE {STRIPPED.format(t='s')} <> '')"""
    of_requests = f"SELECT * FROM ({CONDITIONS}) WHERE note_id IN (SELECT note_id FROM sent WHERE is_clinical)"
    add("request_messages", _with(DOMAIN, *deid_ctes(said), asked, sent, *pool_ctes(6, of_requests), *note_ctes, *LISTS, note_lists,
        *explained("SELECT note_id, s FROM sent"),
        """placed AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN s ELSE text END AS content,
          count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM deid)""",
        """msgs AS (SELECT conv_id, sent.turn, position, role, CASE WHEN placed.turn = sent.turn THEN prompt ELSE content END AS content
          FROM placed JOIN sent ON sent.note_id = conv_id AND placed.turn <= sent.turn JOIN p ON p.note_id = conv_id)""",
        select=f"SELECT conv_id, turn, position, role, {UNNUMBERED.replace('(s,', '(content,')} AS content_md5 FROM msgs"))

    # providers
    add("code_prf", _with(*PROVIDER_BASE, select="SELECT * FROM prf"))
    add("eval_report", _with(*PROVIDER_BASE, *PROVIDER_SCORES, select="SELECT * FROM prow UNION ALL BY NAME SELECT CAST(NULL AS BIGINT) AS case_id, * FROM ptotal"))
    add("comparison_csv", _with(*PROVIDER_BASE, *PROVIDER_SCORES, select="SELECT case_id AS id, * EXCLUDE (case_id) FROM prow"))
    listed = lambda p: f"list_filter(string_split(coalesce(codes_{p}, ''), ' '), lambda x: x <> '')"
    a, b = listed("alpha"), listed("beta")
    add("provider_compare", _with(*PROVIDER_BASE, *PROVIDER_SCORES, select=f"""SELECT *, CASE WHEN codes_alpha IS NOT NULL AND codes_beta IS NOT NULL THEN
      array_to_string(list_sort(list_concat(list_filter({a}, lambda x: NOT list_contains({b}, x)), list_filter({b}, lambda x: NOT list_contains({a}, x)))), ' ')
      END AS code_difference FROM (SELECT case_id, {_side('alpha')}, {_side('beta')} FROM prow GROUP BY 1)"""))
    add("provider_aggregate", _with(*PROVIDER_BASE, *PROVIDER_SCORES, select="""SELECT provider, count(*) AS n_cases, round(avg(code_f1), 3) AS mean_f1,
      round(avg(latency_total), 3) AS mean_latency FROM prow GROUP BY 1"""))
    return sql
