"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns (equal role and text) of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion. A completion is emitted with a mask:
the spans, in characters of prompt plus completion, that a model learns from, which are the bodies and
end marks of the assistant's turns behind the prompt. Everything else, the prompt, the headers of turns
and the turns of others, is masked. If one conversation is a prefix of the other, the prompt stops before
its last turn, so that neither completion is empty.

A turn is rendered as `<|role|>\\n` + text + `<|end|>\\n`. The marks are parameters; where a text or a role
holds one of them, it is broken by a zero-width space, so that a text can't forge a turn.

`pair_up` makes pairs of a table of conversations: those that open with the same first turn are taken two
by two in the order of conv_id within a salt of the group, the better one (more assistant text, then the
smaller conv_id) as chosen. No group is ever in one task: first turns are hashed together with the salt.
A conversation without a partner in its salt meets those left over in other salts. One that stays alone gets a
rejected conversation that is its own up to its last assistant turn, which is replaced by that of its next
neighbour, in a small bucket of such conversations, whose last answer is another one. Only one without an assistant turn, or all of
whose neighbours have the same answer, is returned without a rejected one.

Nulls: a null text is empty, a null role is `unknown`; turns without conv_id form one conversation;
turns of equal number follow each other by role, then text. Repeated rows are repeated turns. An empty table
gives no rows. Ties of assistant text go to the smaller conv_id. Other columns of turns aren't read; of pairs they
stay, but for those named as the new ones. A very long text is rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import written

ASSISTANT = "assistant"
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
#: Salts of a group: conversations with the same first turn are spread over so many keys.
SALTS = 64
#: Conversations to a bucket in which those without a partner find a neighbour.
BUCKET = 64


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns array<struct<role, text>>: one row for each conversation, turns in order."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("<​|"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit(SHUT))


def _body(t: Column) -> Column:
    return F.concat(_safe(t["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column, start: Column) -> Column:
    """array<struct<start, end>>: where the learnt parts of the rendered turns lie, the first turn at `start`."""
    empty = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        out = F.when(t["role"] == ASSISTANT, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.cast("long").alias("at"), out.alias("out"))

    return F.aggregate(turns, empty, step, lambda acc: acc["out"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs (two columns array<struct<role, text>>, rejected may be null) with n_prompt, prompt, and for each side its completion and mask.

    Columns of these names are replaced; all other columns stay.
    """
    new = ["n_prompt", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"]
    kept = [c for c in pairs.columns if c not in {*new, chosen, rejected}]
    a, b = F.col("__a"), F.col("__b")
    base = pairs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{chosen}`").alias("__a"), F.col(f"`{rejected}`").alias("__b"))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    common = F.coalesce(F.get(differs, F.lit(0)) - 1, F.least(F.size(a), F.size(b)) - 1)
    last = F.array_max(F.transform(a, lambda t, i: F.when(t["role"] == ASSISTANT, i)))
    n = F.when(b.isNull(), F.coalesce(last, F.size(a) - 1)).otherwise(common)
    cut = base.withColumn("n_prompt", F.greatest(n, F.lit(0)).cast("int"))
    cut = cut.withColumn("prompt", render(F.slice(a, F.lit(1), F.col("n_prompt"))))
    out = []
    for name, side in (("chosen", a), ("rejected", b)):
        tail = F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side), F.lit(1)))
        out += [render(tail).alias(f"{name}_completion"), spans(tail, F.length("prompt")).alias(f"{name}_mask")]
    return cut.select(*[F.col(f"`{c}`") for c in kept], "n_prompt", "prompt", *out)


def pair_up(turns: DataFrame, salts: int = SALTS) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected: every conversation is chosen or rejected in one row as a whole.

    rejected_id names where the rejected answer is from. turns has conv_id, turn, role and text. Only ids and sizes are dealt while pairing; the turns join the
    finished pairs by conv_id.
    """
    whole = written(conversations(turns), "conversations")  # read by several branches
    good = F.aggregate(F.col("turns"), F.lit(0), lambda n, t: n + F.when(t["role"] == ASSISTANT, F.length(t["text"])).otherwise(0))
    first = F.get(F.col("turns"), F.lit(0))
    ids = whole.select("conv_id", F.xxhash64(first["role"], first["text"]).alias("f1"), F.hash(first["text"], first["role"]).alias("f2"), good.alias("good"), F.xxhash64(_answer(F.col("turns"))["text"]).alias("a"), _answer(F.col("turns")).isNotNull().alias("has"))
    ids = ids.withColumn("a", F.when(F.col("has"), F.col("a"))).drop("has")
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))

    def two_by_two(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("conv_id")) - 1
        return rows.withColumn("pair", F.floor(place / 2)).groupBy(*keys, "pair").agg(F.collect_list(F.struct((-F.col("good")).alias("worse"), "conv_id", "a")).alias("m")).withColumn("m", F.array_sort("m"))

    paired = two_by_two(ids, "f1", "f2", "salt")
    single = paired.where("size(m) = 1").select("f1", "f2", (-F.get("m", F.lit(0))["worse"]).alias("good"), F.get("m", F.lit(0))["conv_id"].alias("conv_id"), F.get("m", F.lit(0))["a"].alias("a"))
    # At most one conversation of each salt is left over: at most `salts` rows of a group meet here.
    pairs = paired.where("size(m) = 2").select("m").unionByName(two_by_two(single, "f1", "f2").select("m"))
    side = lambda i: F.get("m", F.lit(i))["conv_id"]
    pairs = pairs.select(side(0).alias("chosen_id"), side(1).alias("rejected_id"), (F.size("m") == 2).alias("both"), F.get("m", F.lit(0))["a"].alias("a"))
    c = whole.select(F.col("conv_id").alias("c_id"), F.col("turns").alias("chosen"))
    r = whole.select(F.col("conv_id").alias("r_id"), F.col("turns").alias("rejected"))
    two = pairs.where("both")
    real = two.join(c, F.col("chosen_id").eqNullSafe(F.col("c_id"))).join(r, F.col("rejected_id").eqNullSafe(F.col("r_id"))).select("chosen_id", "chosen", "rejected_id", "rejected")
    return real.unionByName(_with_neighbours(pairs.where("NOT both").select(F.col("chosen_id").alias("conv_id"), "a"), whole))


def _answer(turns: Column) -> Column:
    """The last assistant turn, or null."""
    return F.get(F.reverse(F.filter(turns, lambda t: t["role"] == ASSISTANT)), F.lit(0))


def _with_neighbours(alone: DataFrame, whole: DataFrame) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected for conversations without a partner (conv_id, a: what stands for the last answer)."""
    alone = written(alone, "alone")
    buckets = max(1, alone.where("a IS NOT NULL").count() // BUCKET)
    rows = alone.where("a IS NOT NULL").withColumn("b", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    order = Window.partitionBy("b").orderBy("conv_id")
    # All of the bucket, from the next one on round to the one before: some BUCKET ids and answers, no texts.
    ring = F.collect_list(F.struct("conv_id", "a")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.row_number().over(order)
    rows = rows.select("conv_id", "a", ring.alias("ring"), place.alias("place"))
    turned = F.concat(F.slice("ring", F.col("place") + 1, F.size("ring")), F.slice("ring", F.lit(1), F.col("place")))
    next_ = F.get(F.filter(turned, lambda x: x["a"] != F.col("a")), F.lit(0))
    pairs = rows.select("conv_id", next_.alias("next")).select("conv_id", F.col("next").isNotNull().alias("met"), F.col("next.conv_id").alias("rejected_id"))
    own = whole.select(F.col("conv_id").alias("c_id"), F.col("turns").alias("chosen"))
    other = whole.select(F.col("conv_id").alias("r_id"), _answer(F.col("turns")).alias("answer"))
    both = pairs.where("met").join(own, F.col("conv_id").eqNullSafe(F.col("c_id"))).join(other, F.col("rejected_id").eqNullSafe(F.col("r_id")))
    last = F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == ASSISTANT, i)))
    rejected = F.concat(F.slice("chosen", F.lit(1), last), F.array("answer"))
    found = both.select(F.col("conv_id").alias("chosen_id"), "chosen", "rejected_id", rejected.alias("rejected"))
    lone = alone.where("a IS NULL").select("conv_id").unionByName(pairs.where("NOT met").select("conv_id"))
    none = lone.join(own, F.col("conv_id").eqNullSafe(F.col("c_id"))).select(F.col("conv_id").alias("chosen_id"), "chosen", F.lit(None).cast(whole.schema["conv_id"].dataType).alias("rejected_id"), F.lit(None).cast(found.schema["rejected"].dataType).alias("rejected"))
    return found.unionByName(none)
