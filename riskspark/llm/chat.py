r"""Chat formatting with a grammar that reads its own output back.

    turn := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

The parser is deterministic: a start mark opens a turn, the first end mark after it closes it,
and what it reads is unescaped. Whatever the grammar doesn't derive is refused as a whole. A turn that doesn't read back as it was (control strings in the
text, a line break in the role, something that looks escaped) is escaped: every ``<\..\|`` gets
one more backslash, so no control string can remain, and reading takes it away again. The
whole conversation is then read back; if it still differed, all of its turns would be escaped.

All of it is array and string expressions inside one row per conversation, which is also the
unit of the output, so a conversation is the least that one task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import let

#: Marks of the template and the string for a line break in a role.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END), F.lit("\n"))


def _escaped(turn: Column) -> Column:
    return _turn(F.replace(escape(turn["role"]), F.lit("\n"), F.lit(BREAK)), escape(turn["text"]))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation; null for a text outside the grammar.

    Outside are anything before the first start mark or between the end of a turn and the next
    start mark, a turn without its end mark or with two, and one without a line break after
    its role. The empty text is a conversation without turns.
    """

    def whole(piece: Column) -> Column:
        closed = F.endswith(piece, F.lit(f"{END}\n")) & (F.instr(piece, END) == F.length(piece) - len(END))
        return closed & F.contains(F.substring_index(piece, END, 1), F.lit("\n"))

    def one(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    def read(pieces: Column) -> Column:
        turns = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.when((F.get(pieces, F.lit(0)) == "") & F.forall(turns, whole), F.transform(turns, one))

    return let(F.split(formatted, r"<\|im_start\|>", -1), read)


def render(turns: Column) -> Column:
    """(formatted, turns read back, number of escaped turns, whether they read back as they were).

    A conversation that doesn't even read back with all its turns escaped is an error.
    """

    def checked(formatted: Column, escaped: Column) -> Column:
        return let(parse(formatted), lambda back: F.struct(formatted.alias("formatted"), back.alias("turns"), escaped.alias("n_escaped"), back.eqNullSafe(turns).alias("round_trips")))

    def conflicts(turn: Column) -> Column:
        return ~parse(_turn(turn["role"], turn["text"])).eqNullSafe(F.array(turn))

    plain = F.transform(turns, lambda t: F.struct(t.alias("turn"), conflicts(t).alias("conflict")))
    some = lambda marked: F.array_join(F.transform(marked, lambda m: F.when(m["conflict"], _escaped(m["turn"])).otherwise(_turn(m["turn"]["role"], m["turn"]["text"]))), "")
    every = F.array_join(F.transform(turns, _escaped), "")
    first = let(plain, lambda m: let(some(m), lambda f: checked(f, F.size(F.filter(m, lambda x: x["conflict"])))))
    second = let(every, lambda f: checked(f, F.size(turns)))
    return let(let(first, lambda x: F.when(x["round_trips"], x).otherwise(second)), lambda x: F.when(x["round_trips"], x).otherwise(F.raise_error(F.lit("a conversation doesn't read back"))))


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, turns, n_escaped, round_trips), a row per conversation.

    Turns stand by ``turn``, null first; equal ones by role and text, so repeated rows are
    repeated turns. Null roles and texts are empty. Rows without a conversation id form one
    conversation of their own. Extra columns are ignored; no rows give no conversations.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), of(role).alias("role"), of(text).alias("text")).alias("t"))
    whole = each.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    bare = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(F.col("conv").alias(conv), let(bare, render).alias("r")).select(conv, "r.*")


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: those of the assistant."""
    return F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"])
