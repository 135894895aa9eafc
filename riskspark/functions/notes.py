"""Row expressions of the note steps: clinical gate, completion intake, routing."""

from __future__ import annotations

from riskspark.sources import fixed_values as fv

#: Fields of the replies' list elements. All are read as text, so that one of an
#: unexpected type spoils neither its element nor the list.
CONDITION = "struct<condition:string,search_query:string>"
CODE = "struct<icd10:string,description:string,cc:string,condition:string,rationale:string,confidence:string>"


def keyword_hits(text: str) -> str:
    words = ", ".join(f"'{w}'" for w in fv.CLINICAL_KEYWORDS)
    return f"transform(array(lower({text})), t -> size(filter(array({words}), w -> contains(t, w))))[0]"


def is_clinical(text: str) -> str:
    """Long enough without white space at its ends, or enough keywords as substrings (each counts once)."""
    return f"(length({stripped(text)}) > {fv.CLINICAL_MIN_CHARS} OR {keyword_hits(text)} >= {fv.CLINICAL_MIN_KEYWORDS})"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, r'^\s+|\s+$', '')"


def unfenced(reply: str) -> str:
    """Content of a reply that is one whole fenced block, else the reply itself."""
    return stripped(rf"regexp_replace({stripped(reply)}, r'(?i)^```(?:json)?\s*([\s\S]*?)```$', '$1')")


def intake(reply: str, element: str, field: str) -> str:
    """Struct (ok, items, n_bad) of a reply: whether it holds a JSON object, the objects of
    its list (by their JSON type, so a string that looks like one is none), and how many elements are none (a field that is no list counts as one).

    A reply that is no object, or has no such list, gives an empty list.
    """
    raw = f"try_variant_get(try_parse_json(body), '$.{field}', 'array<variant>')"
    is_object = "coalesce(startswith(schema_of_variant(e), 'OBJECT'), false)"
    items = f"transform(filter(raw, e -> {is_object}), e -> from_json(to_json(e), '{element}'))"
    other = f"if(get_json_object(body, '$.{field}') IS NOT NULL, 1, 0)"
    bad = f"if(raw IS NULL, {other}, size(filter(raw, e -> NOT {is_object})))"
    ok = "coalesce(startswith(body, '{') AND try_parse_json(body) IS NOT NULL, false)"
    read = f"transform(array({raw}), raw -> named_struct('ok', {ok}, 'items', coalesce({items}, array()), 'n_bad', {bad}))[0]"
    return f"transform(array({unfenced(reply)}), body -> {read})[0]"


def resolved_provider(override: str, default: str, available: list[str]) -> str:
    """Override, else default, lower-cased and trimmed; an unknown one falls back."""
    known = ", ".join(f"'{p}'" for p in available)
    choice = stripped(f"lower(coalesce(nullif({override}, ''), '{default}'))")
    return f"if({choice} IN ({known}), {choice}, '{default}')"
