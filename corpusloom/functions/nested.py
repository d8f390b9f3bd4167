"""Text of a generated work: flat lines, or lines within scenes within episodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

WORK = "struct<lines:array<struct<text:string,order:double>>,episodes:array<struct<scenes:array<struct<lines:array<string>,beats:array<string>>>>>>"


def work_text(json: Column) -> Column:
    """The lines of a work's JSON (`WORK`), one below the other; an unreadable or empty work is the empty text.

    Flat lines go by their order (a missing one is 0, equal ones stay as they are) and are stripped; without flat lines, episodes and
    scenes go as they come, a scene's beats standing in where it has no lines. Empty lines are left out.
    """

    def of(w: Column) -> Column:
        numbered = F.transform(w["lines"], lambda x, i: F.struct(F.coalesce(x["order"], F.lit(0.0)).alias("o"), i.alias("i"), T.stripped(F.coalesce(x["text"], F.lit(""))).alias("t")))
        flat = F.transform(F.array_sort(numbered), lambda x: x["t"])
        none = F.array().cast("array<string>")
        scenes = F.flatten(F.transform(w["episodes"], lambda e: F.coalesce(e["scenes"], F.array().cast("array<struct<lines:array<string>,beats:array<string>>>"))))
        nested = F.flatten(F.transform(scenes, lambda s: F.coalesce(s["lines"], s["beats"], none)))
        lines = F.when(F.size(F.coalesce(w["lines"], F.array().cast("array<struct<text:string,order:double>>"))) > 0, flat).otherwise(F.coalesce(nested, none))
        return F.array_join(F.filter(lines, lambda s: s != ""), "\n")

    return F.coalesce(T.let(F.from_json(json, WORK), of), F.lit(""))
