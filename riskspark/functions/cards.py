"""Columns of the result cards, as SQL text."""

from __future__ import annotations

from riskspark.sources import fixed_values as fv


def score_tier(score: str) -> str:
    return f"CASE WHEN {score} < {fv.LOW_TIER}D THEN 'low' WHEN {score} < {fv.MID_TIER}D THEN 'mid' ELSE 'high' END"


def percent_vs_average(score: str) -> str:
    """``+126.8% vs avg``; scores have three decimals, so tenths of a percent are exact."""
    tenths = f"cast(round(({score} - 1) * 1000) AS decimal(20,0)) / 10"
    return f"concat(if({score} >= 1, '+', ''), string(cast({tenths} AS decimal(20,1))), '% vs avg')"


def model_label(model: str) -> str:
    cases = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in fv.MODEL_LABELS.items())
    return f"CASE {model} {cases} ELSE {model} END"


def confidence_percent(confidence: str, similarity: str) -> str:
    return f"int(floor(coalesce({confidence}, {similarity}, 0D) * 100 + 0.5D))"
