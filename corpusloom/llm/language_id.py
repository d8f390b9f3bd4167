"""Language identification by hierarchical discrimination.

A one-versus-rest linear support vector machine picks the language family; within it, one linear machine
for each pair of languages votes, and the language with most votes (then the larger sum of margins, then
the smaller name) wins. Features are hashed counts of byte pairs and triples of the lower-cased letters
of the whole text, square-rooted and of unit length.

Only the machines are fitted on a bounded sample: at most `SAMPLE` different labelled texts for each language
and `SAMPLE_ALL` in all, those of least hash; no language that has a labelled text is left out. Prediction streams over all rows without a shuffle and ships only
the weights (some hundred KB a machine).

A text that is null or has no letter is `und` with score 0. With no labelled text at all every text is
`und`. Ties are settled as said above; repeated rows get equal predictions. An empty table gives no rows;
other columns of docs stay, but for those named as the new ones. A very long text is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import frugal
from corpusloom.llm.textbytes import LOWER, blocks, text_bytes

UND = "und"
#: Most labelled texts that the machines are fitted on: of a language, in all.
SAMPLE, SAMPLE_ALL = 500, 4000
BITS = 12
#: Families of languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc rm la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Letters stay (lower case), other ASCII becomes a space, bytes of other characters stay.
FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint8)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) for runs of rows: the features of whole texts."""
    body, offsets = text_bytes(column)
    width = 1 << BITS
    for a, b in blocks(offsets):
        x = FOLD[body[offsets[a] : offsets[b]]].astype(np.uint32)
        at = offsets[a : b + 1] - offsets[a]
        out = np.zeros((b - a, width), np.float32)
        if len(x) > 1:
            doc = np.repeat(np.arange(b - a, dtype=np.int64) << BITS, np.diff(at))
            pair = (x[:-1] << np.uint32(8)) | x[1:]
            code = (pair + np.uint32(1)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            counts = np.bincount(doc[:-1] + code, minlength=(b - a) * width)
            if len(x) > 2:
                triple = (pair[:-1] << np.uint32(8)) | x[2:]
                code = (triple + np.uint32(77)) * np.uint32(2246822519) >> np.uint32(32 - BITS)
                counts += np.bincount(doc[:-2] + code, minlength=(b - a) * width)
            out = np.sqrt(counts.reshape(b - a, width).astype(np.float32))
        out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
        yield a, out


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """(w, b) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    scale = c * weight / len(x)
    step = 1.0 / (1.0 + 4.0 * float(scale.sum()))
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0.0, 1.0 - y * (x @ vw + vb)) * y * scale
        pw, pb = w, b
        w, b = vw - step * (vw - 2 * (slack @ x)), vb + step * 2 * float(slack.sum())
    return w.astype(np.float32), b


def fit_slope(margin: np.ndarray) -> float:
    """k of the probability 1 / (1 + exp(-k * margin)) that a decision is right; margin is signed by the truth."""
    k = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(k * margin, -30, 30)))
        grad = ((1 - p) * margin).mean() - 1e-3 * k
        curve = (p * (1 - p) * margin * margin).mean() + 1e-3
        k = float(np.clip(k + grad / curve, 0.5, 20.0))
    return k


@dataclass
class Model:
    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    family_k: float
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float, float]] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, lang: list[str]) -> Model | None:
        if not lang:
            return None
        of = np.array([FAMILY.get(s, s) for s in lang])
        names, lang = sorted(set(of)), np.array(lang)
        w, b = np.zeros((x.shape[1], len(names)), np.float32), np.zeros(len(names), np.float32)

        def balanced(y: np.ndarray) -> np.ndarray:
            share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
            return (0.5 / share).astype(np.float32)

        if len(names) > 1:
            for i, name in enumerate(names):
                y = np.where(of == name, 1.0, -1.0).astype(np.float32)
                w[:, i], b[i] = fit_machine(x, y, balanced(y))
        m = x @ w + b
        truth = np.searchsorted(names, of)
        rest = m.copy()
        rest[np.arange(len(m)), truth] = -np.inf
        gap = m[np.arange(len(m)), truth] - rest.max(1) if len(names) > 1 else np.ones(1)
        model = Model(names, w, b, fit_slope(gap), {n: sorted(set(lang[of == n])) for n in names})
        for name in names:
            for p, q in combinations(model.languages[name], 2):
                at = (lang == p) | (lang == q)
                y = np.where(lang[at] == p, 1.0, -1.0).astype(np.float32)
                pw, pb = fit_machine(x[at], y, balanced(y))
                model.pairs[p, q] = pw, pb, fit_slope(y * (x[at] @ pw + pb))
        return model

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row; the score is the product of the two levels' probabilities."""
        m = x @ self.family_w + self.family_b
        best = m.argmax(1)
        score = np.ones(len(x))
        if len(self.families) > 1:
            top = np.partition(m, -2, axis=1)[:, -2:]
            score = 1 / (1 + np.exp(-self.family_k * (top[:, 1] - top[:, 0]).astype(float)))
        out = np.empty(len(x), object)
        for i, name in enumerate(self.families):
            rows, langs = np.flatnonzero(best == i), self.languages[name]
            if not len(rows):
                continue
            votes, margins = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            chance = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                w, bias, k = self.pairs[langs[a], langs[b]]
                d = (x[rows] @ w + bias).astype(float)
                p = 1 / (1 + np.exp(-np.clip(k * d, -30, 30)))
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                margins[:, a] += d
                margins[:, b] -= d
                chance[:, a] += p
                chance[:, b] += 1 - p
            order = np.lexsort((-margins, -votes), axis=1)[:, 0] if len(langs) > 1 else np.zeros(len(rows), int)
            out[rows] = np.array(langs, object)[order]
            if len(langs) > 1:
                score[rows] *= chance[np.arange(len(rows)), order] / (len(langs) - 1)
        return out, np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The machines from a bounded sample of different labelled texts; rows with a null language or without a letter are passed over."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("lang", "text"))
    # Different texts of each language, within some hundredths.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()}
    if not counts:
        return None
    most = max(2, min(SAMPLE, SAMPLE_ALL // len(counts)))
    share = F.create_map(*[F.lit(v) for s, n in counts.items() for v in (s, int(min(1.0, (1.2 * most + 50) / (0.9 * n)) * 1_000_000))])
    # Texts that repeat meet in one hash and count once.
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")]).dropDuplicates(["h", "lang"]).select("h", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(has_letter(b.column(2)))
            for a, x in features(b.column(2)):
                n = len(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), b.column(1).slice(a, n), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["h", "lang", "x"])

    got: dict[str, list] = {}
    for r in chosen.mapInArrow(run, "h long, lang string, x binary").collect():  # at most about 1.5 * SAMPLE_ALL rows
        got.setdefault(r["lang"], []).append((r["h"], bytes(r["x"])))
    names = [(s, x) for s in sorted(got) for _, x in sorted(got[s])[:most]]
    x = np.frombuffer(b"".join(x for _, x in names), np.float16).reshape(len(names), -1).astype(np.float32)
    return Model.fit(x, [s for s, _ in names])


def has_letter(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    at = kept.columns.index(text)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = np.full(len(b), UND, object), np.zeros(len(b))
            known = has_letter(b.column(at)).to_numpy(zero_copy_only=False)
            if model:
                for a, x in features(b.column(at)):
                    rows = np.flatnonzero(known[a : a + len(x)])
                    lang[a + rows], score[a + rows] = model.predict(x[rows])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
