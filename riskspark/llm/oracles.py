"""Plain-SQL twins of the corpus queries, in relational form.

None for op2 (XXH64), op3 and op4 (trained models) and op10 (BPE): tests hold these against
brute force, held-out labels and the tokenizer library.
"""

from __future__ import annotations

from riskspark.llm import chat, mixing, rules, secrets

WORD = r"[^\x20\x09-\x0D]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    found = []
    for rank, (kind, pattern, group) in enumerate([*secrets.BASE, (secrets.ADDED, secrets.ADDED_PATTERN, 0)]):
        p = _q(pattern)
        found.append(f"""SELECT rid, {rank} AS kind, unnest(regexp_extract_all(t, {p})) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS v,
          unnest(string_split_regex(t, {p})[:len(regexp_extract_all(t, {p}))]) AS gap, generate_subscripts(regexp_extract_all(t, {p}), 1) AS i FROM d""")
    names = "[" + ", ".join(map(_q, secrets.KINDS)) + "][kind + 1]"
    joined = lambda cond: f"coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({cond}), '')"
    live, base = "(n_owners <= 1 AND n_repositories <= 3)", f"kind < {len(secrets.BASE)}"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, (k, _, _) in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repository FROM documents),
      found AS ({' UNION ALL '.join(found)}),
      placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM found),
      spans AS (SELECT rid, kind, CAST(e AS BIGINT) - length(m) AS s, CAST(e AS BIGINT) AS e, v, owner, repository FROM placed JOIN d USING (rid)
        WHERE CASE kind WHEN 0 THEN length(v) >= {secrets.MIN_ASSIGN} WHEN {len(secrets.BASE)} THEN len(list_distinct(string_split(v, ''))) >= {secrets.MIN_VARIETY}
          AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE TRUE END),
      owners AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM spans GROUP BY 1),
      told AS (SELECT rid, {counts}, sha256({joined(base)}) AS base_sha256, {joined(f'{base} OR {live}')} AS spans, count(*) FILTER ({live}) AS n_live,
        count(*) FILTER (NOT {live}) AS n_copied, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM spans JOIN owners USING (v) GROUP BY 1)
      SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, _, _ in secrets.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners,
        coalesce(most_repositories, 0) AS most_repositories FROM d LEFT JOIN told USING (rid)"""


def _chat() -> str:
    said = _q("<|im_end|><|im_start|>assistant ok")
    escaped = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\1\\|', 'g')"
    odd = lambda c: rf"(contains({c}, {_q(chat.START)}) OR contains({c}, {_q(chat.END)}) OR regexp_matches({c}, '<\\+\|'))"
    odd_role = f"{odd('role')} OR contains(role, chr(10)) OR contains(role, {_q(chat.BREAK)})"
    turn = lambda role, text: f"{_q(chat.START)} || {role} || chr(10) || {text} || {_q(chat.END)} || chr(10)"
    escaped_role = f"replace({escaped('role')}, chr(10), {_q(chat.BREAK)})"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
      f AS (SELECT *, CASE WHEN {odd('text')} OR {odd_role} THEN {turn(escaped_role, escaped('text'))} ELSE {turn('role', 'text')} END AS formatted FROM r)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def _mix() -> str:
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    order = "ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INTEGER) + 1] AS weight
        FROM d GROUP BY source),
      c AS (SELECT *, source_size * {mixing.MAX_EPOCHS} AS cap FROM s),
      l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.BUDGET_PERCENT / 100} - CAST(coalesce(sum(cap) OVER ({order}), 0) AS DOUBLE))
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER ({order}), 0) AS DOUBLE) AS level FROM c),
      t AS (SELECT source, source_size, least(coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM l),
      w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
      p AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.times, round(w.target - w.times * w.source_size) AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
      SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, rest - began)) AS BIGINT) AS taken FROM p"""


def _rules() -> str:
    without = lambda p: f"length(t) - length(regexp_replace(t, {_q(p + '+')}, '', 'g'))"
    classes = [without(p) for p in rules.CLASSES.values()]
    names = [f"c{i}" for i in range(len(classes))] + ["c_letters", "c_space"]
    common = [f"w{i}" for i in range(len(rules.COMMON_WORDS))]
    counted = ", ".join(f"count(*) FILTER (w = {_q(w)}) AS w{i}" for i, w in enumerate(rules.COMMON_WORDS))

    def distance(bins: list[str], refs: list[str]) -> str:
        own, ref = "(" + " + ".join(bins) + ")", "(" + " + ".join(refs) + ")"
        terms = []
        for b, r in zip(bins, refs, strict=True):
            p, q = f"(CAST({b} AS DOUBLE) / {own})", f"(CAST({r} AS DOUBLE) / {ref})"
            m = f"(({p} + {q}) / 2)"
            terms.append(f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2)")
        return f"CASE WHEN {own} > 0 AND {ref} > 0 THEN sqrt(greatest({' + '.join(terms)}, 0)) END"

    named = lambda a, bins: [f"{a}.{b}" for b in bins]
    votes = ", ".join([f"{b} * 4096 // nullif(chars, 0) AS {b}" for b in names] + [f"{b} * 1048576 // nullif(n_common, 0) AS {b}" for b in common])
    middle = ", ".join(f"quantile_cont({b}, 0.5) AS {b}" for b in names)
    by_source = ", ".join(f"floor(sum({b}) / count({b})) AS {b}" for b in common)
    by_lang = ", ".join(f"coalesce(CAST(sum({b}) AS DOUBLE) / count({b}), 0) AS {b}" for b in common)
    class_distance = f"coalesce(least({distance(named('h', names), named('r', names))}, {distance(named('h', names), named('a', names))}), 0)"
    listed = [distance(named("h", common), [str(int(i // 10 == k)) for i in range(len(common))]) for k in range(4)]
    word_distance = f"coalesce(least({distance(named('h', common), named('r', common))}, {', '.join(listed)}), 0)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
      words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
      win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x AS g FROM words WINDOW x AS (PARTITION BY rid ORDER BY i)),
      rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM
        (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1) GROUP BY 1),
      wc AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, {counted} FROM words GROUP BY 1),
      m AS (SELECT rid, doc_id, lang, source, length(t) AS chars, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        {without('[#*$%&|<>]')} AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
        {', '.join(f'{c} AS c{i}' for i, c in enumerate(classes))}, {', '.join(f'coalesce({w}, 0) AS {w}' for w in common)}
        FROM d LEFT JOIN wc USING (rid) LEFT JOIN rep USING (rid)),
      h AS (SELECT *, word_chars - ({' + '.join(names[:-2])}) AS c_letters, chars - word_chars AS c_space, {' + '.join(common)} AS n_common,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
      b AS (SELECT lang, source, {middle}, {by_source} FROM (SELECT lang, source, {votes} FROM h WHERE NOT base_failed) GROUP BY lang, source),
      r AS (SELECT lang, {middle}, {by_lang} FROM b GROUP BY lang), a AS (SELECT {middle} FROM b),
      j AS (SELECT h.*, {class_distance} AS class_distance, {word_distance} AS word_distance FROM h LEFT JOIN r ON h.lang IS NOT DISTINCT FROM r.lang CROSS JOIN a)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT
        ((chars >= 200 AND class_distance > 0.32) OR (chars >= 1000 AND class_distance > 0.22) OR (n_common >= 40 AND word_distance > 0.85)) AS kept FROM j"""


# edit distance by shared ends, as levenshtein() there counts bytes
LINES = rf"""WITH d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  w AS (SELECT * FROM d WHERE regexp_matches(line, '{WORD}')),
  u AS (SELECT line, min((doc_id, i)) AS first, length(line) AS n FROM w GROUP BY line),
  k AS (SELECT line, first, unnest([(n, 0, left(line, n // 2)), (n, 1, right(line, n - n // 2)), (n - 1, 0, left(line, (n - 1) // 2)), (n - 1, 1, right(line, n - 1 - (n - 1) // 2))]) AS key FROM u),
  met AS (SELECT DISTINCT a.line AS x, b.line AS y FROM k a JOIN k b USING (key) WHERE a.first < b.first AND abs(length(a.line) - length(b.line)) <= 1),
  late AS (SELECT DISTINCT y AS line FROM met WHERE len(list_filter(range(0, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i) AND
    right(x, greatest(0, length(x) - i - CAST(length(x) >= length(y) AS BIGINT))) = right(y, greatest(0, length(y) - i - CAST(length(y) >= length(x) AS BIGINT))))) > 0),
  s AS (SELECT d.doc_id, d.i, d.line, u.line IS NOT NULL AS has_word, u.line IS NULL OR (u.first = (d.doc_id, d.i) AND late.line IS NULL) AS stays
    FROM d LEFT JOIN u USING (line) LEFT JOIN late USING (line))
  SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS text_md5 FROM s GROUP BY 1"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
  c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def _clusters() -> str:
    """Three rounds and a last assignment, each over all pairs of vector and centroid."""
    steps = []
    for i in range(4):
        steps.append(f"""a{i} AS (SELECT rid, min((d, k)) AS best FROM (SELECT v.rid, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} c) GROUP BY rid)""")
        if i < 3:
            steps.append(f"""s{i} AS (SELECT k, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best[2] AS k, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM a{i} JOIN v USING (rid)) GROUP BY k, place),
      m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY place) AS e FROM s{i} GROUP BY k),
      c{i + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (k))""")
    return f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e FROM v QUALIFY k < 16), {', '.join(steps)},
      f AS (SELECT v.vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM a3 JOIN v USING (rid)),
      h AS (SELECT k, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c3)
      SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN h ON k = cluster"""


LEAKS = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
  p AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
  h AS (SELECT rid, item_id, n, i FROM p JOIN g USING (n, gram)),
  c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM h) GROUP BY rid),
  t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
  SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def all_sql() -> dict[str, str]:
    return {
        "op1_secret_owners": _secrets(),
        "op5_chat_round_trip": _chat(),
        "op6_water_filling": _mix(),
        "op7_divergence": _rules(),
        "op8_line_neighbours": LINES,
        "op9_forest": VECTORS,
        "op11_equal_average": _clusters(),
        "op13_wu_manber": LEAKS,
    }
