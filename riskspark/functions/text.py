"""Tokens and n-grams, as SQL text."""

from __future__ import annotations

#: Runs of two or more letters, digits or underscores of any script; the usual ones are listed, as Java finds listed ones faster.
TOKEN_PATTERN = r"[abcdefghijklmnopqrstuvwxyz0123456789_\p{L}\p{N}]{2,}"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), r'{TOKEN_PATTERN}', 0)"


def bigrams(token_array: str) -> str:
    """Neighbours in the token list (short tokens are already gone), joined by a blank."""
    n = f"greatest(size({token_array}) - 1, 0)"
    return f"zip_with(slice({token_array}, 1, {n}), slice({token_array}, 2, {n}), (a, b) -> concat(a, ' ', b))"


def ngrams(text: str) -> str:
    """Tokens followed by bigrams; the token list is computed once."""
    return f"transform(array({tokens(text)}), t -> concat(t, {bigrams('t')}))[0]"
