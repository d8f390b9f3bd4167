"""Replies of a judge or writer as column expressions: JSON out of prose, acceptance, cards, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that a structure was left out, in any of four forms.
ELISIONS = (r"\{\s*\.\.\.\s*\}", r"JSON\s*\.\.\.", r"[\[,:]\s*\.\.\.", r"\.\.\.\s*[,\]\}]")
#: Characters of a text that a prompt of each kind takes.
LIMITS = {"vote": 2000, "packed": 1200, "annotation": 6000}
_FENCE = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"


def salvaged_json(reply: Column) -> Column:
    """A fenced object or list, else the first balanced braces, else the reply; nothing is trimmed but its ends."""
    body = F.regexp_replace(reply, r"^\s+|\s+$", "")
    tail = F.substring(body, F.instr(body, "{"), F.length(body))
    # Each piece ends in a brace, so the fold has a step for a brace and not for a character.
    pieces = F.regexp_extract_all(tail, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        at = a["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((a["end"] == 0) & (depth == 0), at).otherwise(a["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda a: a["end"])
    fence = F.regexp_extract(body, _FENCE, 1)
    braces = F.when(F.contains(body, F.lit("{")) & (end > 0), F.substring(tail, F.lit(1), end))
    return F.when(fence != "", fence).otherwise(F.coalesce(braces, body))


def parses(text: Column) -> Column:
    """Whether text is one JSON value: a parser that stops early is caught by a list and by an object around it."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def accepted_json(text: Column) -> Column:
    """Whether text opens as an object or list, parses as a whole and leaves nothing out; null is not accepted."""
    whole = text.rlike(r"^\s*[\{\[]") & parses(text) & ~text.rlike("|".join(ELISIONS))
    return F.coalesce(whole, F.lit(False))


def cards(reply: Column, n: Column | int) -> Column:
    """array<string>: the objects of the first list, if it is JSON of exactly n elements, else null."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    each = F.when(parses(found), F.from_json(found, "array<string>"))
    return F.when(F.size(each) == n, F.filter(each, lambda x: x.startswith("{")))


def labels(reply: Column, n: int, field: str, known: list[str]) -> Column:
    """array<string> of n labels: field of the n objects of a reply's list, null where it isn't a known label.

    A reply without a list of exactly n elements gives n nulls; mentions in front of it are left out, an element that is no object
    has no label.
    """
    found = F.regexp_extract(F.regexp_replace(reply, r"^(?:\s*@\S+)+", ""), r"(?s)\[.*\]", 0)
    each = F.when(parses(found), F.from_json(found, "array<string>"))
    label = F.transform(each, lambda x: F.when(x.startswith("{"), F.trim(F.get_json_object(x, f"$.{field}"))))
    fine = F.transform(label, lambda v: F.when(v.isin(known), v))
    return F.when(F.size(each) == n, fine).otherwise(F.array_repeat(F.lit(None).cast("string"), n))


def limited(text: Column, purpose: str) -> Column:
    """As much of a text as a prompt of that kind takes."""
    return F.substring(text, 1, LIMITS[purpose])
