"""Text primitives as column expressions; lengths are in code points, null texts stay null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.profile import BREAK, LINE_BREAK, SPACES, Profile


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeezed(text: Column) -> Column:
    """text without any white space."""
    return F.translate(text, SPACES, "")


def solid_length(text: Column) -> Column:
    return F.length(squeezed(text))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


#: Letters that only Spark's upper() changes: their upper case is two letters or more, or newer than Unicode 15. DuckDB's leaves them.
UNCASED = "".join(c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1 and (len(c.title()) > 1 or c.title() == c) and c != "ß") + "".join(map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))))


def uppered(text: Column) -> Column:
    """text in upper case; one that only letters of UNCASED would change stays as it is, as in DuckDB."""
    bare = F.translate(text, UNCASED, "")
    return F.when(~text.rlike("[a-z]") & (F.upper(bare) == bare), text).otherwise(F.upper(text))


def raw_lines(text: Column) -> Column:
    """Lines as Python's splitlines() gives them: no empty line behind a final break."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(text, LINE_BREAK), whole)


def lines(text: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(text, BREAK), stripped), lambda s: s != "")


def sentences(text: Column, profile: Profile) -> Column:
    end = profile.sentence_end
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[^{end}]*[{end}]|[^{end}]+"), F.lit(0)), stripped), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, or the lines if there is only one block."""
    blocks = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda s: s != "")
    return let(blocks, lambda b: F.when(F.size(b) <= 1, lines(text)).otherwise(b))


def tokens(text: Column, profile: Profile) -> Column:
    """Greedy, non-overlapping runs."""
    return F.regexp_extract_all(F.lower(text) if profile.token_fold else text, F.lit(profile.token), F.lit(0))


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a non-empty phrase."""
    return ((F.length(text) - F.length(F.replace(text, phrase))) / F.length(phrase)).cast("long")


def letter_ratio(text: Column, profile: Profile) -> Column:
    z = squeezed(text)
    return F.when(z == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(z, f"[^{profile.letter}]", "")) / F.length(z))


def mean_and_cv(values: Column) -> tuple[Column, Column]:
    """(mean, population deviation over mean) of an array of numbers; 0 where it is empty or the mean is 0."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    var = F.greatest(squares / n - mean * mean, F.lit(0.0))
    return mean, F.when((n > 0) & (mean > 0), F.sqrt(var) / mean).otherwise(0.0)


def base32_id(key: Column) -> Column:
    """26 characters of base 32 from the first 128 bits of SHA-256 of a string."""
    def digits(bits: Column) -> Column:
        digit = lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1))
        return F.concat(*[digit(i) for i in range(26)])

    as_bits = lambda h: F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])
    return let(F.sha2(key, 256), lambda h: let(as_bits(h), digits))


#: Fixed value: the digits of ids.
BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


def split_of(key: Column) -> Column:
    """exam, train or val by a stable hash of the key: a fifth, three fifths, a fifth."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < 20, "exam").when(h < 80, "train").otherwise("val")


def iso_week(ts: Column) -> Column:
    return F.when(ts.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)))


def last_of_each(pairs: Column) -> Column:
    """A map from array<struct<k, v>> in which the last value of a key wins."""
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def packed_votes(reply: Column, n: int) -> Column:
    """array<string> of n letters from a reply such as `1:A 2:B`; '' where there is none.

    Numbered votes count, the last one for a number; only without any, the first n letters in order.
    """
    up = F.upper(F.regexp_replace(reply, r"^(?:\s*@\S+)+", ""))
    found = F.regexp_extract_all(up, F.lit(r"(\d{1,6})\s*[:：.、]\s*[AB]"), F.lit(0))
    pairs = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^(\d+)", 1).cast("int").alias("k"), F.regexp_extract(s, "([AB])$", 1).alias("v")))
    numbered = last_of_each(F.filter(pairs, lambda p: (p["k"] >= 1) & (p["k"] <= n)))
    plain = F.regexp_extract_all(up, F.lit("[AB]"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(F.size(numbered) > 0, F.coalesce(F.element_at(numbered, i), F.lit(""))).otherwise(F.coalesce(F.get(plain, i - 1), F.lit(""))))


def vote_letter(reply: Column) -> Column:
    return F.regexp_extract(F.upper(F.regexp_replace(reply, r"^(?:\s*@\S+)+", "")), "[AB]", 0)


def head_mid_tail(text: Column, limit: int) -> Column:
    """A text of up to 3 * limit characters whole; of a longer one its head, middle and tail, limit characters each."""
    mid = F.substring(text, (F.floor((F.length(text) - limit) / 2) + 1).cast("int"), F.lit(limit))
    return F.when(F.length(text) <= 3 * limit, text).otherwise(F.array_join(F.array(F.substring(text, 1, limit), mid, F.right(text, F.lit(limit))), "\n……\n"))
