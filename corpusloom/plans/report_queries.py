"""Queries of reports, bands with status, frequencies within texts, scores with fallback, packs and pairs against the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import frequency, replies
from corpusloom.functions import text as T
from corpusloom.operators import cards, digest, exam, judging, pairs, reports
from corpusloom.plans import catalogue as C
from corpusloom.plans import corpus_queries, judging_queries  # noqa: F401 - their SQL is used below
from corpusloom.plans.catalogue import P, documents, query, table
from corpusloom.sources.tables import written

# --- Bands and their documents -------------------------------------------------------------------------------

_SEGMENTS = f"""e AS (SELECT doc_id, unnest(ls) s, generate_subscripts(ls, 1) i FROM card0),
sg AS (SELECT *, sum(CASE WHEN regexp_matches(s, '{P.title}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) seg FROM e),
sc AS (SELECT doc_id, seg, sum(length({C._Z("s")})) chars FROM sg GROUP BY 1, 2), md AS (SELECT doc_id, median(chars) m FROM sc GROUP BY 1),
card AS (SELECT card0.*, CASE WHEN n_episodes > 0 THEN len(hook_positions) / n_episodes ELSE 0.0 END hook_density, coalesce(m, 0.0) ep_char_median FROM card0 LEFT JOIN md USING (doc_id))"""
_SEVEN = ", ".join(f"round(CAST({m} AS DOUBLE), 4) AS {m}" for m in cards.METRICS)
_WITH_BANDS = C.CARD.replace("\ncard AS (", "\ncard0 AS (") + f",\n{_SEGMENTS},\n" + C._bands("card", "kind", _SEVEN).replace("SELECT grp, metric, CAST(n", "bd AS (SELECT grp, metric, CAST(n")
_WITH_BANDS = _WITH_BANDS.replace("\nbd AS (", ",\nbd AS (") + ")"
_STATUS = f"CASE WHEN (SELECT count(*) FROM documents) >= {cards.LEAST_CARDS} THEN 'corpus' ELSE 'placeholder' END"


def _cards(spark, d):
    c = cards.cards(documents(spark, d).select("lang", "text"), P)
    return c.withColumns({m: F.round(F.col(m).cast("double"), 4) for m in cards.METRICS if m != "n_episodes"})


def _bands(spark, d):
    c = written(_cards(spark, d).select("kind", *cards.METRICS), "cards")
    return cards.checked_bands(c, {m: m for m in cards.METRICS}, "kind")


@query(f"WITH {_WITH_BANDS} SELECT *, {_STATUS} AS status FROM bd")
def bands_by_kind(spark, d):
    """All seven metrics of the cards, over all and by kind."""
    return _bands(spark, d)


_P = lambda c: f"coalesce(printf('%.4f', {c}), '-')"
_N6 = lambda c: f"coalesce(printf('%.6f', {c}), '-')"
_BAND_LINE = lambda indent: f"'{indent}' || metric || ': {{p25: ' || {_N6('p25')} || ', p50: ' || {_N6('p50')} || ', p75: ' || {_N6('p75')} || '}}'"


@query(f"""WITH {_WITH_BANDS}, k AS (SELECT grp, max(n) n FROM bd WHERE grp IS NOT NULL GROUP BY grp)
SELECT 0 AS section, '' AS part, CAST(generate_subscripts(l, 1) - 1 AS DOUBLE) AS place, unnest(l) AS line FROM (SELECT ['version: 2', 'n_scripts: ' || max(n), 'data_source: "documents"', 'status: ' || {_STATUS}, 'bands:'] l FROM bd WHERE grp IS NULL)
UNION ALL SELECT 1, metric, 0, {_BAND_LINE("  ")} FROM bd WHERE grp IS NULL UNION ALL SELECT 2, '', 0, 'by_kind:'
UNION ALL SELECT 3, grp, generate_subscripts(l, 1) - 4, unnest(l) FROM (SELECT grp, ['  "' || grp || '":', '    n: ' || n, '    bands:'] l FROM k) UNION ALL SELECT 3, grp, 0, {_BAND_LINE("      ")} FROM bd WHERE grp IS NOT NULL""")
def report_bands(spark, d):
    return reports.bands_yaml(written(_bands(spark, d), "bands"), "documents")


@query(f"""WITH {_WITH_BANDS}, k AS (SELECT grp, max(n) n FROM bd WHERE grp IS NOT NULL GROUP BY grp)
SELECT 0 AS section, '' AS part, CAST(generate_subscripts(l, 1) - 1 AS DOUBLE) AS place, unnest(l) AS line FROM (SELECT ['# Profile of the corpus', '', '- scripts: **' || count(*) || '**', '- characters without white space: ' || CAST(sum(total_chars) AS BIGINT), '- episodes: ' || min(n_episodes) || ' to ' || max(n_episodes)] l FROM card)
UNION ALL SELECT 1, kind, 0, '- kind ' || kind || ': ' || count(*) FROM card GROUP BY kind UNION ALL SELECT 2, coalesce(lang, '-'), 0, '- genre ' || coalesce(lang, '-') || ': ' || count(*) FROM card GROUP BY lang
UNION ALL SELECT 3, grp, generate_subscripts(l, 1) - 6, unnest(l) FROM (SELECT grp, ['', '## Bands of ' || grp || ' (n=' || n || ')', '', '| metric | P25 | P50 | P75 |', '|---|---|---|---|'] l FROM k)
UNION ALL SELECT 3, grp, 0, '| ' || metric || ' | ' || {_N6("p25")} || ' | ' || {_N6("p50")} || ' | ' || {_N6("p75")} || ' |' FROM bd WHERE grp IS NOT NULL""")
def report_profile(spark, d):
    c = written(_cards(spark, d).select("kind", "lang", "total_chars", *cards.METRICS), "cards")
    return reports.profile_report(c, written(cards.checked_bands(c, {m: m for m in cards.METRICS}, "kind"), "bands"), "lang")


# --- Exam, dashboard, smoke test, digest ----------------------------------------------------------------------

_LINES = lambda section, lines, rest: f"SELECT {section} AS section, '' AS part, CAST(generate_subscripts(l, 1) - 1 AS DOUBLE) AS place, unnest(l) AS line FROM (SELECT [{', '.join(lines)}] l {rest})"
_Q = lambda *lines: [f"'{s}'" for s in lines]
_CELLS = lambda *c: "'| ' || " + " || ' | ' || ".join(c) + " || ' |'"


@query(f"""WITH ex AS ({C.SQL['exam_votes_axis']}) {_LINES(0, [*_Q("# Exam of the judges", "", "- judge: votes"), "CASE WHEN count(*) > 0 AND bool_and(pass) THEN '- result: **PASS**, scores count' ELSE '- result: **FAIL**, scores are only reported' END",
 *_Q("", "| axis | n | sensitivity | block sensitivity | position bias | pair flip rate | pass |", "|---|---|---|---|---|---|---|")], "FROM ex")}
UNION ALL SELECT 1, axis, 0, {_CELLS("axis", "n_pairs", _P("sensitivity"), _P("block_sensitivity"), _P("position_bias"), _P("pair_flip_rate"), "CASE WHEN pass THEN 'yes' ELSE 'no' END")} FROM ex""")
def report_exam(spark, d):
    return reports.exam_report(exam.axis_metrics(C._votes(spark, d)), "votes")


_PART = "lpad(CAST(round AS VARCHAR), 20, '0')"
_IF = lambda s: f"CASE WHEN n > 0 THEN '{s}' END"
_NONE = "CASE WHEN n = 0 THEN '_no data_' END"
_GOOD = "decision LIKE 'accepted%' OR decision = 'promoted'"


@query(f"""WITH {C._LSQL}, sl AS (SELECT * FROM lg WHERE kind = 'ab' AND sealed_score IS NOT NULL), bt AS (SELECT *, abs(sealed_score - winrate) > 0.15 ap FROM sl WHERE winrate IS NOT NULL),
bl AS (SELECT * FROM lg WHERE kind = 'blind_corpus' AND winrate IS NOT NULL), la AS (SELECT count(*) n, arg_max(round, ts) r, arg_max(coalesce(ci_lo, 0), ts) c FROM sl), ct AS (SELECT count(*) n, count(*) FILTER (ap) a FROM bt),
tr AS (SELECT count(*) n, arg_min(winrate, ts) f, arg_max(winrate, ts) l FROM bl), de AS (SELECT count(*) n, count(*) FILTER ({_GOOD}) g FROM lg WHERE kind = 'ab' AND decision <> ''), wo AS ({C.SQL['panel_worst_axis']}), tl AS (SELECT count(*) n FROM lg),
al AS ({_LINES(10, [*_Q("# Dashboard", "", "## 1. Sealed win rate", ""), _IF("| round | win rate | CI95 | sealed |"), _IF("|---|---|---|---|"), _NONE], "FROM la")}
UNION ALL SELECT 11, {_PART}, ts, {_CELLS("round", _N6("winrate"), f"'[' || {_N6('ci_lo')} || ', ' || {_N6('ci_hi')} || ']'", _N6("sealed_score"))} FROM sl
UNION ALL {_LINES(12, [_IF(""), "CASE WHEN n > 0 THEN '**latest round ' || r || CASE WHEN c > 0.5 THEN ': ahead, the interval is above 0.5**' ELSE ': not ahead, the interval reaches 0.5 or less: roll back**' END END"], "FROM la")}
UNION ALL {_LINES(20, [*_Q("", "## 2. Open against sealed", ""), "CASE WHEN n > 0 THEN '- rounds with both: ' || n || '; more than 0.15 apart: **' || a || '**' ELSE '_no data_' END", "CASE WHEN n > 0 AND a = 0 THEN '- none apart, open scores can be trusted' END"], "FROM ct")}
UNION ALL SELECT 21, {_PART}, ts, '  - round ' || round || ': open ' || {_N6("winrate")} || ', sealed ' || {_N6("sealed_score")} FROM bt WHERE ap
UNION ALL {_LINES(30, [*_Q("", "## 3. Blind win rate", ""), _IF("| round | blind win rate |"), _IF("|---|---|"), _NONE], "FROM tr")}
UNION ALL SELECT 31, {_PART}, ts, {_CELLS("round", _N6("winrate"))} FROM bl
UNION ALL {_LINES(32, ["CASE WHEN n >= 2 AND l <= f THEN '' END", "CASE WHEN n >= 2 AND l <= f THEN '**the blind rate does not rise: the inner figures may be spoiled**' END"], "FROM (SELECT n, l, f FROM tr)")}
UNION ALL {_LINES(40, [*_Q("", "## 4. Defects found", ""), "coalesce('- worst axis: **' || printf('%.4f', worst) || '**' || CASE WHEN closed THEN ', gate closed' ELSE ', gate open' END, '_no data_')"], "FROM wo")}
UNION ALL {_LINES(50, [*_Q("", "## 5. Accepted experiments", ""), "CASE WHEN n > 0 THEN '- decisions ' || n || ', accepted ' || g || ': ' || CASE WHEN g / n BETWEEN 0.3 AND 0.7 THEN 'healthy' WHEN g = n THEN 'all accepted: cheated or noise' WHEN g / n > 0.7 THEN 'too many' ELSE 'too few' END ELSE '_no data_' END"], "FROM de")}
UNION ALL {_LINES(60, [*_Q("", "## Latest rows", ""), _IF("| round | kind | decision | win rate | sealed |"), _IF("|---|---|---|---|---|"), _NONE], "FROM tl")}
UNION ALL SELECT 61, '', -ts, {_CELLS("round", "kind", "coalesce(decision, '-')", _N6("winrate"), _N6("sealed_score"))} FROM (SELECT * FROM lg ORDER BY ts DESC, round DESC LIMIT 20))
SELECT * FROM al WHERE line IS NOT NULL""")
def report_dashboard(spark, d):
    """The dashboard of the ledger that is made of all events, with the exam of all documents."""
    columns = C._LEDGER.removeprefix("SELECT ").removesuffix(" FROM events")
    ledger = table(spark, d, "events").select(*[F.expr(c) for c in columns.split(",\n") for c in C._columns(c)])
    return reports.dashboard(ledger, written(exam.axis_metrics(C._votes(spark, d)), "exam"))


@query(f"""WITH g AS ({C.SQL['smoke_groups']}) {_LINES(0, [*_Q("# Smoke test", "", "- judge: values"), "'- candidates: ' || count(*)", *_Q("", "| candidate | n | wins | losses | ties | win rate |", "|---|---|---|---|---|---|")], "FROM g")}
UNION ALL SELECT 1, candidate, 0, {_CELLS("candidate", "n_pairs", "wins", "losses", "ties", _P("winrate"))} FROM g""")
def report_smoke(spark, d):
    return reports.smoke_report(C.QUERIES["smoke_groups"](spark, d), "values")


@query(f"""WITH p AS ({C.SQL['pattern_digest']}), h AS ({C.SQL['digest_head']}) {_LINES(0, [*_Q("# Patterns", ""), "'- cards: ' || n || '; median of episodes: ' || coalesce(printf('%.1f', median), '-')"], "FROM h")}
UNION ALL SELECT 1, kind, generate_subscripts(l, 1) - 4, unnest(l) FROM (SELECT DISTINCT kind, ['', '## ' || kind, ''] l FROM p) UNION ALL SELECT 1, kind, rank, '- ' || item || ' ×' || n FROM p""")
def report_digest(spark, d):
    head = digest.digest_head(cards.cards(documents(spark, d).select("text"), P), F.col("n_episodes"))
    return reports.digest_report(head, written(C.QUERIES["pattern_digest"](spark, d), "patterns"))


# --- Within texts and replies ----------------------------------------------------------------------------------

_SPEECH = r"^([a-zA-Zà-öø-ÿ]{1,8})[ ,:]"


@query(f"""WITH l AS (SELECT doc_id, {C._LINES} ls FROM documents), u AS (SELECT doc_id, regexp_extract(s, '{_SPEECH}', 1) name, i FROM (SELECT doc_id, unnest(ls) s, generate_subscripts(ls, 1) i FROM l)),
c AS (SELECT doc_id, name, count(*) n, min(i) f FROM u WHERE name <> '' AND name <> 'the' GROUP BY 1, 2)
SELECT doc_id, name, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS INT) AS rank FROM c""")
def speakers_by_frequency(spark, d):
    """The first words of lines as speakers, of every document."""
    each = documents(spark, d).select("doc_id", F.posexplode(frequency.speakers(F.col("text"), _SPEECH, "the")).alias("i", "x"))
    return each.select("doc_id", F.col("x.item").alias("name"), F.col("x.n").cast("long").alias("n"), (F.col("i") + 1).alias("rank"))


@query(f"""WITH u AS (SELECT doc_id, unnest(x) t, generate_subscripts(x, 1) i FROM (SELECT doc_id, regexp_extract_all(text, '{P.token}') x FROM documents)),
c AS (SELECT doc_id, t, count(*) n, min(i) f FROM u GROUP BY 1, 2), b AS (SELECT doc_id, t FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)
SELECT doc_id, t AS token FROM documents LEFT JOIN b USING (doc_id)""")
def frequent_token(spark, d):
    return documents(spark, d).select("doc_id", frequency.most_frequent(F.col("text"), P.token).alias("token"))


@query("""SELECT doc_id, length(f) AS chars, md5(f) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE
substr(text, 1, 300) || chr(10) || '……' || chr(10) || substr(text, (length(text) - 300) // 2 + 1, 300) || chr(10) || '……' || chr(10) || right(text, 300) END f FROM documents)""")
def fragments(spark, d):
    f = T.head_mid_tail(F.col("text"), 300)
    return documents(spark, d).select("doc_id", F.length(f).cast("long").alias("chars"), F.md5(f).alias("digest"))


@query(r"SELECT conv_id, turn, regexp_extract(upper(regexp_replace('@judge ' || text, '^(?:\s*@\S+)+', '')), '[AB]', 0) AS letter FROM conversations")
def vote_letters(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.vote_letter(F.concat(F.lit("@judge "), "text")).alias("letter"))


#: Replies that label two works, some of them cut, short or in words that aren't known.
_LABEL_SQL = """'@clerk ' || CASE event_id % 4 WHEN 0 THEN 'here: [{"genre": "' || event_type || '"}, {"genre": " view "}]' WHEN 1 THEN '[{"genre": "' || event_type || '"}]' WHEN 2 THEN '[{"genre": "other"}, "' || event_type || '"]' ELSE '[{"genre": "' || event_type || '"}, {' END"""
_KNOWN = ["click", "view", "purchase"]


@query(rf"""WITH r AS (SELECT event_id, event_type, regexp_extract(regexp_replace({_LABEL_SQL}, '^(?:\s*@\S+)+', ''), '(?s)\[.*\]', 0) b FROM events), j AS (SELECT *, CASE WHEN b <> '' AND json_valid(b) THEN json_extract(b, '$[*]') END l FROM r),
v AS (SELECT event_id, CASE WHEN len(l) = 2 THEN list_transform(l, lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN trim(json_extract_string(x, '$.genre')) END) ELSE [NULL, NULL] END g FROM j)
SELECT event_id, CASE WHEN g[1] IN ('click', 'view', 'purchase') THEN g[1] END AS first, CASE WHEN g[2] IN ('click', 'view', 'purchase') THEN g[2] END AS second FROM v""")
def reply_labels(spark, d):
    got = replies.labels(F.expr(_LABEL_SQL), 2, "genre", _KNOWN)
    return table(spark, d, "events").select("event_id", got[0].alias("first"), got[1].alias("second"))


# --- Scores, packs, promotion, pairs ------------------------------------------------------------------------------

@query("""WITH d AS (SELECT user_id p, event_id % 2 d, CASE WHEN user_id % 5 = 0 THEN 0.5 ELSE event_id % 10 / 10 END f, CASE WHEN user_id % 5 = 0 THEN 0.5 WHEN user_id % 7 <> 0 THEN (event_id + 3) % 10 / 10 END s FROM events WHERE user_id % 3 <> 0),
v AS (SELECT user_id p, event_id % 2 = 0 fa, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END l FROM events WHERE user_id % 2 = 0),
t AS (SELECT p, avg(f) FILTER (d = 0) a0, avg(s) FILTER (d = 0) b0, avg(f) FILTER (d = 1) b1, avg(s) FILTER (d = 1) a1, bool_and(f = 0.5 AND s = 0.5) h, count(*) c FROM d GROUP BY p),
r AS (SELECT *, CASE WHEN a0 IS NULL OR a1 IS NULL OR b0 IS NULL OR b1 IS NULL THEN 'missing' WHEN h THEN 'flat' END x FROM t),
w AS (SELECT p, count(*) n, avg(CAST(l = CASE WHEN fa THEN 'A' ELSE 'B' END AS INT)) va FROM v GROUP BY p),
b AS (SELECT p, a0, a1, b0, b1, c, n, va, CASE WHEN c IS NULL THEN 'missing' ELSE x END x FROM r FULL JOIN w USING (p))
SELECT p AS pair_id, round(CASE WHEN x IS NULL THEN (a0 + a1) / 2 ELSE va END, 6) AS score_a, round(CASE WHEN x IS NULL THEN (b0 + b1) / 2 ELSE 1 - va END, 6) AS score_b, CASE WHEN x IS NULL THEN 'compare' WHEN n IS NOT NULL THEN 'votes' END AS engine, CASE WHEN x IS NULL THEN c ELSE coalesce(n, 0) END AS calls, x AS reason FROM b""")
def pair_scores(spark, d):
    """Users as pairs: scores of their events in either direction, votes where these fail."""
    e = table(spark, d, "events")
    flat, i = F.col("user_id") % 5 == 0, F.col("event_id")
    first = F.when(flat, 0.5).otherwise(i % 10 / 10)
    second = F.when(flat, 0.5).when(F.col("user_id") % 7 != 0, (i + 3) % 10 / 10)
    directed = e.where("user_id % 3 <> 0").select(F.col("user_id").alias("pair_id"), (i % 2).alias("direction"), first.alias("score_first"), second.alias("score_second"))
    letter = F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("")
    votes = e.where("user_id % 2 = 0").select(F.col("user_id").alias("pair_id"), (i % 2 == 0).alias("first_is_a"), letter.alias("letter"))
    return judging.scored_pairs(directed, votes).withColumns({c: F.round(c, 6) for c in ("score_a", "score_b")})


_PACKED = "SELECT pair_id, axis, direction, k_index, CAST((row_number() OVER (PARTITION BY axis ORDER BY pair_id, direction, k_index) - 1) // 7 AS INT) AS pack FROM ({}), (SELECT unnest([0, 1]) direction), (SELECT unnest([0, 1, 2]) k_index)"


@query(_PACKED.format("SELECT doc_id pair_id, lang axis FROM documents"))
def vote_packs(spark, d):
    return exam.packs(documents(spark, d).select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("axis")), 3, 7)


@query(f"WITH {C._LSQL} SELECT round, coalesce(ci_lo * 10 > 0.5 AND round % 20 >= 12 AND sealed_score IS NOT NULL, false) AS promote FROM lg WHERE kind = 'ab'")
def promotions(spark, d):
    """Which experiments of the ledger the rule lets through."""
    columns = C._LEDGER.removeprefix("SELECT ").removesuffix(" FROM events")
    ledger = table(spark, d, "events").select(*[F.expr(c) for c in columns.split(",\n") for c in C._columns(c)]).where("kind = 'ab'")
    return exam.promoted(ledger.withColumn("ci_lo", F.col("ci_lo") * 10).withColumn("n_briefs", F.col("round") % 20)).select("round", "promote")


@query("SELECT doc_id FROM documents WHERE length(text) >= 1200 ORDER BY doc_id LIMIT 300")
def model_budget(spark, d):
    """The 300 first long documents, which a model is asked about: the limit is the feature."""
    return pairs.capped(documents(spark, d).where(F.length("text") >= 1200).select("doc_id"), "doc_id")


_CARD_OF = lambda source: C.CARD.replace("FROM documents)", f"FROM ({source}))", 1)
_GENERATED = "SELECT doc_id, lang, source, substr(text, 1, 1200) AS text FROM documents WHERE source = 'src5' AND text IS NOT NULL"
_THREE = ", ".join(f"round(CAST({m} AS DOUBLE), 4) AS {m}" for m in sorted(set(pairs.AXIS_METRICS.values())))
_AXES = ", ".join(f"struct_pack(axis := '{a}', metric := '{m}', v := CAST({m} AS DOUBLE))" for a, m in pairs.AXIS_METRICS.items())
_AGAINST = f"""bd AS (WITH {C.CARD}, {C._bands("card", "lang", _THREE)}), gn AS (WITH {_CARD_OF(_GENERATED)} SELECT doc_id, text, {", ".join(sorted(set(pairs.AXIS_METRICS.values())))} FROM card),
lo AS (SELECT doc_id, text, unnest([{_AXES}], recursive := true) FROM gn), ou AS (SELECT lo.* FROM lo JOIN bd ON bd.grp IS NULL AND bd.metric = lo.metric WHERE v < p25 OR v > p75),
hd AS (SELECT doc_id cid, substr(text, 1, 1200) a FROM documents WHERE source <> 'src5' AND text IS NOT NULL ORDER BY doc_id, text LIMIT 20),
pr AS (SELECT axis, ou.doc_id gen_id, cid, a, ou.text b, {C._SPLIT("CAST(cid AS VARCHAR)")} split FROM ou, hd)"""


def _against(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), "source", "text")
    c = cards.cards(docs, P)
    metrics = sorted(set(pairs.AXIS_METRICS.values()))
    band = cards.checked_bands(c.withColumns({m: F.round(F.col(m).cast("double"), 4) for m in metrics}), {m: m for m in metrics})
    return pairs.against_corpus(docs.where("source = 'src5'"), band, docs.where("source <> 'src5'"), P)


@query(f"""WITH {_AGAINST}, k AS (SELECT *, sha256(axis || '|' || sha256(a || chr(0) || b) || '|corpus_vs_gen|') k FROM pr), bi AS (SELECT *, {C._TOBITS} bits FROM k)
SELECT 'pair:' || {C._B32} AS pair_id, axis, CAST(gen_id AS VARCHAR) AS run, CAST(cid AS VARCHAR) AS script, split, length(a) AS a_chars, length(b) AS b_chars FROM bi""")
def pairs_against_corpus(spark, d):
    """One source's documents as generated texts against the first texts of the others, on four axes."""
    p = _against(spark, d)
    return p.select("pair_id", "axis", F.col("construction.source_run_id").alias("run"), F.col("construction.source_script_id").alias("script"), "split", F.length("a_text").cast("long").alias("a_chars"), F.length("b_text").cast("long").alias("b_chars"))


@query(f"WITH {_AGAINST} SELECT split, kind, count(*) AS n FROM (SELECT split, 'corpus_vs_gen' kind FROM pr) GROUP BY ROLLUP (split, kind)")
def pairs_summary(spark, d):
    return pairs.summary(_against(spark, d))
