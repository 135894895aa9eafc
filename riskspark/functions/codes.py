"""Code and number normalisation, as SQL text."""

from __future__ import annotations

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def normalize_code(code: str) -> str:
    """Upper case, no dots, no white space of any kind at the ends."""
    return rf"upper(regexp_replace(string({code}), r'^\s+|\s+$|\.', ''))"


def tolerant_int(text: str) -> str:
    """Whole part of a number written as text; null when it is no number."""
    number = f"try_cast(trim(string({text})) AS double)"
    return f"CASE WHEN string({text}) rlike r'{_NUMBER}' THEN try_cast(if({number} >= 0, floor({number}), ceil({number})) AS int) END"
