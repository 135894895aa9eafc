"""Age rules written as text, compiled to data that Catalyst evaluates.

A rule joins (possibly chained) comparisons between ``age`` and numbers by ``or``, ``and``,
``not`` and parentheses. It is parsed once per row of the code map, into an array (or) of arrays (and)
of ``struct<l, op, r>`` in which a null operand stands for the age. Text outside the
grammar compiles to null, and a null rule holds for everyone.

The functions return SQL text: one parse on the JVM instead of a call per operator.
"""

from __future__ import annotations

_OPERAND = r"(?:age|-?(?:0|[1-9]\d*)(?:\.\d+)?)"
_OP = r"(?:<=|>=|==|!=|<|>)"
_TERM = rf"^\s*{_OPERAND}(?:\s*{_OP}\s*{_OPERAND})*\s*$"
_TOKEN = rf"({_OP}|{_OPERAND})"


_CHAIN = rf"{_OPERAND}(?:\s*{_OP}\s*{_OPERAND})*"


def _normal(rule: str, strict: bool) -> str:
    text = rf"regexp_replace(lower({rule}), r'age\s*(\d+)\s*\+', 'age >= $1')"
    if not strict:
        text = f"replace({text}, '==', '?')"
    return f"regexp_replace({text}, r'(?<![<>!=])=(?!=)', '==')"


def compile_rule(rule: str, strict: bool = False) -> str:
    """SQL expression that parses the rule text in column ``rule``.

    A doubled equals sign is malformed in the rule language (a single one is the
    operator), so such a rule leaves the grammar and holds; ``strict`` accepts it.
    """
    text = _normal(rule, strict)
    return rf"if({rule} rlike r'[()]|(?i)\bnot\b', {_compile_nested(text)}, {_compile_flat(text)})"


def _compile_flat(text: str) -> str:
    """A rule without parentheses and ``not``, comparison by comparison."""
    ors = rf"transform(split({text}, r'\s+or\s+'), p -> split(p, r'\s+and\s+'))"
    tokens = f"regexp_extract_all(term, r'{_TOKEN}', 1)"
    chain = """transform(sequence(0, size(tokens) - 3, 2), i -> named_struct(
        'l', try_cast(tokens[i] AS double), 'op', tokens[i + 1], 'r', try_cast(tokens[i + 2] AS double)))"""
    bare = "array(named_struct('l', try_cast(tokens[0] AS double), 'op', '!=', 'r', 0D))"
    comparisons = f"transform(array({tokens}), tokens -> if(size(tokens) = 1, {bare}, {chain}))[0]"
    return f"""transform(array({ors}), ors -> if(
        forall(flatten(ors), term -> term rlike r'{_TERM}'),
        transform(ors, ands -> flatten(transform(ands, term -> {comparisons}))),
        null))[0]"""


def _compile_nested(text: str) -> str:
    """A rule with parentheses or ``not``, as the intervals of whole ages at which it holds.

    A rule can change its answer only next to a number that stands in it. So it is answered at
    those ages (comparisons first, then ``!``, ``&`` and ``|`` are reduced as text until one
    answer is left), and runs of ages that hold become intervals. Anything that doesn't reduce
    to an answer is outside the grammar.
    """
    number = lambda x: f"if({x} = 'age', double(age), try_cast({x} AS double))"
    l, op, r = number("k[i]"), "k[i + 1]", number("k[i + 2]")
    holds = f"CASE {op} WHEN '<' THEN {l} < {r} WHEN '<=' THEN {l} <= {r} WHEN '>' THEN {l} > {r} WHEN '>=' THEN {l} >= {r} WHEN '==' THEN {l} = {r} ELSE {l} != {r} END"
    answer = f"transform(array(regexp_extract_all(c, r'{_TOKEN}', 1)), k -> if(size(k) = 1, {number('k[0]')} != 0, forall(sequence(0, size(k) - 3, 2), i -> {holds})))[0]"
    filled = f"array_join(transform(sequence(0, size(parts) - 1), n -> concat(parts[n], coalesce(transform(array(get(chains, n)), c -> if(c IS NULL, '', if({answer}, 'T', 'F')))[0], ''))), '')"
    step = "s"
    for pattern, by in ((r"\(([TF])\)", "$1"), ("!T", "F"), ("!F", "T"), ("(?<!!)T&T", "T"), ("(?<!!)(?:T&F|F&T|F&F)", "F"), (r"(?<![&!])T\|[TF](?!&)", "T"), (r"(?<![&!])F\|([TF])(?!&)", "$1")):
        step = f"regexp_replace({step}, r'{pattern}', '{by}')"
    reduced = f"aggregate(sequence(1, length(skeleton)), {filled}, (s, n) -> {step})"
    skeleton = rf"regexp_replace({text}, r'{_CHAIN}', '@')"
    for word, sign in (("and", "&"), ("or", "|"), ("not", "!")):
        skeleton = rf"regexp_replace({skeleton}, r'\b{word}\b', '{sign}')"
    skeleton = rf"regexp_replace({skeleton}, r'\s+', '')"
    near = r"flatten(transform(regexp_extract_all(whole, r'-?\d+(?:\.\d+)?', 0), x -> transform(sequence(-1, 1), d -> bigint(floor(double(x))) + d)))"
    ages = f"array_sort(array_distinct(concat({near}, array(-1L, 0L, 1L))))"
    bound = lambda sign, j: f"named_struct('l', double(null), 'op', '{sign}', 'r', double(ages[{j}]))"
    end = "array_min(filter(sequence(0, size(ages) - 1), j -> j > i AND answers[j] = 'F'))"
    interval = f"transform(array({end}), e -> filter(array(if(i > 0, {bound('>=', 'i')}, null), if(e IS NOT NULL, {bound('<', 'e')}, null)), x -> x IS NOT NULL))[0]"
    starts = "filter(sequence(0, size(ages) - 1), i -> answers[i] = 'T' AND (i = 0 OR answers[i - 1] = 'F'))"
    valid = "skeleton rlike r'^[@&|!()]+$' AND forall(answers, x -> x IN ('T', 'F'))"
    runs = f"if({valid}, transform({starts}, i -> {interval}), null)"
    answers = f"transform(array(transform(ages, age -> {reduced})), answers -> {runs})[0]"
    inner = f"transform(array(split(skeleton, '@')), parts -> transform(array({ages}), ages -> {answers})[0])[0]"
    inner = f"transform(array(regexp_extract_all(whole, r'{_CHAIN}', 0)), chains -> {inner})[0]"
    inner = f"transform(array({skeleton.replace(text, 'whole')}), skeleton -> {inner})[0]"
    return f"transform(array({text}), whole -> {inner})[0]"


def rule_fails_open(rule: str, compiled: str) -> str:
    """True for a rule that is present but outside the grammar."""
    return f"({rule} IS NOT NULL AND {compiled} IS NULL)"


def rule_holds(compiled: str, age: str) -> str:
    left, right = f"coalesce(c.l, double({age}))", f"coalesce(c.r, double({age}))"
    holds = f"""CASE c.op WHEN '<' THEN {left} < {right} WHEN '<=' THEN {left} <= {right}
        WHEN '>' THEN {left} > {right} WHEN '>=' THEN {left} >= {right}
        WHEN '==' THEN {left} = {right} ELSE {left} != {right} END"""
    return f"coalesce(exists({compiled}, ands -> forall(ands, c -> {holds})), true)"


#: Bounds that are packed into one number; a rule with a bound outside goes another way.
MIN_AGE, MAX_AGE = -1000, 7000


def is_interval(compiled: str) -> str:
    """The rule is absent or one interval of ages: no ``or``, no ``!=``, no constants, no far bounds."""
    inside = f"coalesce(c.l, c.r) BETWEEN {MIN_AGE + 1} AND {MAX_AGE - 1}"
    plain = f"c.op != '!=' AND ((c.l IS NULL) != (c.r IS NULL)) AND {inside}"
    return f"({compiled} IS NULL OR (size({compiled}) = 1 AND forall({compiled}[0], c -> {plain})))"


def interval_ends(compiled: str) -> tuple[str, str]:
    """Lowest and highest whole age of a rule that is an interval."""
    low = f"""CASE WHEN c.op = '==' THEN ceil(coalesce(c.l, c.r))
        WHEN c.l IS NULL AND c.op = '>' THEN floor(c.r) + 1 WHEN c.l IS NULL AND c.op = '>=' THEN ceil(c.r)
        WHEN c.r IS NULL AND c.op = '<' THEN floor(c.l) + 1 WHEN c.r IS NULL AND c.op = '<=' THEN ceil(c.l) ELSE {MIN_AGE} END"""
    high = f"""CASE WHEN c.op = '==' THEN floor(coalesce(c.l, c.r))
        WHEN c.l IS NULL AND c.op = '<' THEN ceil(c.r) - 1 WHEN c.l IS NULL AND c.op = '<=' THEN floor(c.r)
        WHEN c.r IS NULL AND c.op = '>' THEN ceil(c.l) - 1 WHEN c.r IS NULL AND c.op = '>=' THEN floor(c.l) ELSE {MAX_AGE} END"""
    clamp = lambda x: f"bigint(greatest({MIN_AGE}, least({MAX_AGE}, {x})))"
    return (
        f"coalesce(array_max(transform({compiled}[0], c -> {clamp(low)})), {MIN_AGE}L)",
        f"coalesce(array_min(transform({compiled}[0], c -> {clamp(high)})), {MAX_AGE}L)",
    )
