"""Degradations without a draw, as column expressions over the lines of a text, and deletions within a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profile import SPACE
from corpusloom.operators.degrade import BRAND, HOOKS, MOST_DELETED, PARTICLES, PAYOFF, SPOKEN


def setup_cut(text: Column) -> Column:
    """Without the lines that carry the payoff mark, however many they are; a text without one stays as it is."""
    kept = F.array_join(F.filter(T.raw_lines(text), lambda s: ~s.contains(PAYOFF)), "\n")
    return F.when(text.contains(PAYOFF), kept).otherwise(text)


def formalized(text: Column) -> Column:
    """At full severity: every spoken line loses the particles at its end, before two closing marks at most."""
    flat = lambda s: F.regexp_replace(s, f"[{PARTICLES}]+([!?。！？]{{0,2}}[{SPACE}]*)$", "$1")
    return F.array_join(F.transform(T.raw_lines(text), lambda s: F.when(T.stripped(s).rlike(SPOKEN), flat(s)).otherwise(s)), "\n")


def deleted_within_budget(text: Column, victim: Callable[[Column], Column], share: float = MOST_DELETED) -> Column:
    """Without the victims, line by line, as long as what is deleted stays within a share of the text's solid characters.

    A victim that would go beyond it stays, and later, shorter ones may still go. If none can go the text stays as it is.
    """
    def of(x: Column) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("gone"), F.array().cast("array<int>").alias("at"))

        def step(a: Column, v: Column) -> Column:
            goes = a["gone"] + v["cost"] <= x["most"]
            return F.when(goes, F.struct((a["gone"] + v["cost"]).alias("gone"), F.concat(a["at"], F.array(v["i"])).alias("at"))).otherwise(a)

        gone = F.aggregate(x["victims"], state, step, lambda a: a["at"])
        return T.let(gone, lambda at: F.when(F.size(at) == 0, text).otherwise(F.array_join(F.filter(x["lines"], lambda s, i: ~F.array_contains(at, i)), "\n")))

    def found(ls: Column) -> Column:
        each = F.filter(F.transform(ls, lambda s, i: F.struct(i.alias("i"), F.when(victim(s), T.solid_length(s).cast("long")).alias("cost"))), lambda v: v["cost"].isNotNull())
        return F.struct(ls.alias("lines"), each.alias("victims"), (T.solid_length(text) * share).alias("most"))

    return T.let(T.let(T.raw_lines(text), found), of)


def is_brand(line: Column) -> Column:
    return line.rlike(BRAND.pattern)


def is_hook(line: Column) -> Column:
    out = F.lit(False)
    for mark in HOOKS:
        out = out | line.contains(mark)
    return out
