"""Chat formatting: a finite-state machine over roles checks the turn order,
and a declarative template turns a conversation into text segments, each with
a loss flag.  DataFrame functions only.

Template: a turn is ``open`` + escaped text + ``close`` of its role; only the
text of a role with ``loss`` counts for the loss.  A role the template does
not name is written as ``[ROLE] `` role `` [TEXT] `` text `` [/ROLE]``.
Control strings inside texts (and role names) get one backslash after their
first character; a string that already looks escaped gets one more, so taking
one backslash away from each gives the text back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Declarative template: role -> (open, close, loss).
TEMPLATE: dict[str, tuple[str, str, bool]] = {
    "system": ("[SYS] ", " [/SYS]", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("[OUT] ", "</s>", True),
}
BEGIN = "<s>"
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "[ROLE] ", " [TEXT] ", " [/ROLE]"
#: All control strings (first character, rest): none is inside or overlaps another.
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]")
#: Turn order: state -> role -> next state; a missing entry is an error.
TRANSITIONS: dict[str, dict[str, str]] = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
START, ERROR = "start", "error"


def _alternatives(first: str) -> str:
    rest = [c[1:].replace("[", r"\[").replace("]", r"\]") for c in CONTROLS if c[0] == first]
    return "|".join(rest)


def escape(text: Column) -> Column:
    """One backslash after the first character of every control string."""
    for first, pattern in (("<", "<"), ("[", r"\[")):
        text = F.regexp_replace(text, rf"{pattern}(\\*)({_alternatives(first)})",
                                ("<" if first == "<" else r"\[") + r"\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for first, pattern in (("<", "<"), ("[", r"\[")):
        text = F.regexp_replace(text, rf"{pattern}\\(\\*)({_alternatives(first)})",
                                ("<" if first == "<" else r"\[") + "$1$2")
    return text


def _pick(role: Column, part: int, other: Column) -> Column:
    out = other
    for name, spec in TEMPLATE.items():
        out = F.when(role == name, F.lit(spec[part])).otherwise(out)
    return out


def _next_state(state: Column, role: Column) -> Column:
    steps = [((state == s) & (role == r), t) for s, by in TRANSITIONS.items() for r, t in by.items()]
    return reduce(lambda out, x: F.when(x[0], F.lit(x[1])).otherwise(out), steps, F.lit(ERROR))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted (string), segments
    (array of start, length in code points of ``formatted``, role, loss), in
    turn order, valid (the role order is accepted) and bad_turn (index of the
    first turn that is not, else null).

    Turns are ordered by turn (nulls first), ties by role, then text; equal
    rows are turns of their own.  Null texts and roles are empty strings.  A
    conversation whose order is not accepted is formatted all the same and
    flagged.  All rows with a null conv_id are one conversation.  A
    conversation is one output row, so its turns meet in one task; nothing
    larger does."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    conv = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))
    # nulls-first order of array_sort's struct comparison is what the docstring says
    known = lambda r: r.isin(*TEMPLATE)
    head = lambda t: F.when(known(t["role"]), _pick(t["role"], 0, F.lit(""))).otherwise(
        F.concat(F.lit(OTHER_OPEN), escape(t["role"]), F.lit(OTHER_TEXT)))
    conv = conv.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), head(t).alias("open"), escape(t["text"]).alias("body"),
        _pick(t["role"], 1, F.lit(OTHER_CLOSE)).alias("close"))).alias("parts"))
    states = F.aggregate(
        "parts", F.struct(F.lit(START).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad")),
        lambda a, p: F.struct(
            _next_state(a["state"], p["role"]).alias("state"), (a["i"] + 1).alias("i"),
            F.coalesce(a["bad"], F.when(_next_state(a["state"], p["role"]) == ERROR, a["i"])).alias("bad")))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int,role:string,loss:boolean>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["open"]) + F.length(p["body"]) + F.length(p["close"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(p["open"])).alias("start"), F.length(p["body"]).alias("length"),
                p["role"].alias("role"), _pick(p["role"], 2, F.lit(False)).cast("boolean").alias("loss")))).alias("out")))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform(
        "parts", lambda p: F.concat(p["open"], p["body"], p["close"])), ""))
    return conv.select("conv_id", text.alias("formatted"), spans["out"].alias("segments"), states["bad"].alias("bad_turn")).withColumn(
        "valid", F.col("bad_turn").isNull())


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "[]/<>" else c for c in s)


def turn_pattern() -> str:
    """Pattern of one whole turn in a formatted text."""
    forms = [rf"{_literal(a)}.*?{_literal(b)}" for a, b, _ in TEMPLATE.values()]
    forms.append(rf"{_literal(OTHER_OPEN)}.*?{_literal(OTHER_CLOSE)}")
    return "(?s)" + "|".join(forms)


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) parsed back from a formatted text alone."""
    def parse(x: Column) -> Column:
        inner = F.substring(x, F.length(F.lit(OTHER_OPEN)) + 1,
                            F.length(x) - len(OTHER_OPEN) - len(OTHER_CLOSE))
        cut = F.instr(inner, F.lit(OTHER_TEXT))
        role = unescape(F.substring(inner, F.lit(1), cut - 1))
        text = F.substring(inner, cut + len(OTHER_TEXT), F.length(inner))
        for name, (a, b, _) in TEMPLATE.items():
            hit = F.startswith(x, F.lit(a))
            role = F.when(hit, F.lit(name)).otherwise(role)
            text = F.when(hit, F.substring(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(turn_pattern()), F.lit(0)), parse)


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["length"]))), "")
