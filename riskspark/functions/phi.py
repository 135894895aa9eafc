"""Patterns and numbered replacement of identifiers, as SQL text."""

from __future__ import annotations

from riskspark.sources import fixed_values as fv

#: A month's name or its short form, and a day in its month.
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"

#: Pattern types in pass order. An e-mail goes before a URL; a security number, a card
#: and an address go before a phone, whose pattern would take part of them.
PATTERNS = {
    "EMAIL_ADDRESS": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+",
    "URL": r"(?i:https?://|www\.)[^\s\[\]<>\x22\x27]+",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b",
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "PHONE_NUMBER": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b",
    "DATE_TIME": rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|(?i:{_MONTH} {_DAY},? \d{{4}}|{_DAY} {_MONTH},? \d{{4}}))\b",
}

#: What a text must contain for a pattern to match at all; tested first, because most
#: texts hold none of it and the test is far cheaper than the pattern.
NEEDS = {
    "EMAIL_ADDRESS": "contains({s}, '@')",
    "URL": "(contains({s}, '://') OR contains(lower({s}), 'www.'))",
    "US_SSN": r"{s} rlike r'\d{{3}}-\d\d-\d'",
    "CREDIT_CARD": r"{s} rlike r'\d{{4}}[ -]?\d{{4}}'",
    "IP_ADDRESS": r"{s} rlike r'\d\.\d'",
    "PHONE_NUMBER": r"{s} rlike r'\d{{3}}[ .-]\d{{4}}'",
    "DATE_TIME": r"{s} rlike r'\d[/-]\d|[A-Za-z][.,]? \d{{4}}|\d,? \d{{4}}'",
    "MRN": "(contains(lower({s}), 'mrn') OR contains(lower({s}), 'medical record'))",
}

#: Types found by a table of known names rather than by a pattern.
GAZETTEER_TYPES = ["PERSON", "LOCATION", "MEDICAL_LICENSE"]

_WORD = r"[\p{L}\p{N}_]"


def sql_pattern(pattern: str) -> str:
    return f"r'{pattern}'"


def start_redaction(text: str) -> str:
    """State of a redaction: the text so far and the number of matches of each pass."""
    return f"named_struct('s', {text}, 'n', cast(array() AS array<int>))"


def redaction_pass(state: str, pattern: str, placeholder: str, needs: str = "true") -> str:
    """The state after one pass: the text is split at the matches, and the i-th gap is
    filled with ``placeholder`` and i. ``needs`` is a cheap test without which nothing
    matches.

    Each intermediate value is bound to a lambda variable, so the chain of passes is one
    expression that evaluates every step once, wherever the optimizer moves it.
    """
    joined = f"array_join(transform(x, (t, i) -> if(i > 0, concat('{placeholder}', i, ']', t), t)), '')"
    after = f"named_struct('s', {joined}, 'n', array_append(d.n, size(x) - 1))"
    return f"transform(array({state}), d -> transform(array(if({needs.format(s='d.s')}, split(d.s, {pattern}, -1), array(d.s))), x -> {after})[0])[0]"


def phrase_tokens(text: str) -> str:
    """Word tokens (any length) used to compare a text with a table of names."""
    # the usual characters are listed, as Java finds listed ones faster
    return f"regexp_extract_all(lower({text}), r'[abcdefghijklmnopqrstuvwxyz0123456789{_WORD[1:]}+', 0)"


def names_pattern(keys: str) -> str:
    """A pattern for any of the names, longest first; tokens may be apart by any
    non-word characters. Null where there is no name, which leaves a text alone."""
    # names are token runs, so they hold no pattern characters; only blanks need care
    ordered = f"array_sort({keys}, (a, b) -> length(b) - length(a))"
    alternatives = rf"array_join(transform({ordered}, n -> replace(n, ' ', r'[^\p{{L}}\p{{N}}_]+')), '|')"
    return rf"if(size({keys}) > 0, concat(r'(?iu)(?<!{_WORD})(?:', {alternatives}, r')(?!{_WORD})'), null)"


MRN = f"r'{fv.MRN_PATTERN}'"


def placeholder_types(text: str) -> str:
    """Entity type of every placeholder in a text."""
    return f"regexp_extract_all({text}, r'{fv.PLACEHOLDER_PATTERN}', 1)"


def raw_identifiers(note: str) -> str:
    """Security numbers, phones, e-mails and record numbers, in that order, repeats kept."""
    whole = [fv.RAW_SSN_PATTERN, fv.RAW_PHONE_PATTERN, fv.RAW_EMAIL_PATTERN]
    parts = [f"regexp_extract_all({note}, r'(?U){p}', 0)" for p in whole]
    parts.append(f"regexp_extract_all({note}, r'{fv.RAW_MRN_PATTERN}', 1)")
    return f"concat({', '.join(parts)})"
