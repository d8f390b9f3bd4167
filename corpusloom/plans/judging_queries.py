"""Registered queries of excerpts, replies, judging and upkeep, over texts and votes made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.operators import cards, excerpts, judging, lexicon, upkeep
from corpusloom.plans.catalogue import _PENALTY, _PHRASES, _STRIP, _Z, CARD, P, _bands, documents, query, table

# --- Excerpts -------------------------------------------------------------------------------------------------

_PS = f"list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda p: NOT starts_with(p, '#')), lambda p: {_STRIP('p')}), lambda p: p <> '')"
_OPEN = "string_split(a || p || chr(10), chr(1))[-1]"
_FOLD = f"string_split(list_reduce(list_prepend('', {_PS}), lambda a, p: a || p || chr(10) || CASE WHEN length({_OPEN}) >= 700 THEN chr(1) ELSE '' END), chr(1))"


@query(f"""WITH f AS (SELECT doc_id, {_FOLD} x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(x) s, generate_subscripts(x, 1) i, len(x) n FROM f)
SELECT doc_id, CAST(i AS INT) AS pack, length({_STRIP("s")}) AS chars, md5({_STRIP("s")}) AS digest FROM p WHERE i < n OR length(s) >= 350""")
def paragraph_packs(spark, d):
    packs = documents(spark, d).select("doc_id", F.posexplode(excerpts.paragraph_packs(F.col("text"))).alias("i", "s"))
    return packs.select("doc_id", (F.col("i") + 1).alias("pack"), F.length("s").cast("long").alias("chars"), F.md5("s").alias("digest"))


#: A script of each document: its lines as speech, a scene for each twenty sentences or so, every third line an action.
_SCRIPT_SQL = "'# title' || chr(10) || '### 场 1' || chr(10) || replace(replace(text, '. ', chr(10) || '甲：'), '!', chr(10) || '### 场 2' || chr(10) || '△')"


def _scripts(spark, d):
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n甲：")), F.lit("!"), F.lit("\n### 场 2\n△"))
    return documents(spark, d).select("doc_id", F.concat(F.lit("# title\n### 场 1\n"), text).alias("script"))


_SCENES = f"""s AS (SELECT doc_id, {_SCRIPT_SQL} t FROM documents), b AS (SELECT doc_id, string_split(replace(t, chr(10) || '### 场 ', chr(1) || '### 场 '), chr(1)) x FROM s),
sc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) k, {_STRIP("s")} s FROM (SELECT doc_id, unnest(x) s, generate_subscripts(x, 1) i FROM b) WHERE starts_with(s, '### 场'))"""


@query(f"WITH {_SCENES} SELECT doc_id, CAST(k AS INT) AS scene, length(s) AS chars, md5(s) AS digest FROM sc")
def script_scenes(spark, d):
    found = _scripts(spark, d).select("doc_id", F.posexplode(excerpts.scenes(F.col("script"))).alias("i", "s"))
    return found.select("doc_id", (F.col("i") + 1).alias("scene"), F.length("s").cast("long").alias("chars"), F.md5("s").alias("digest"))


@query(f"""WITH {_SCENES}, g AS (SELECT doc_id, k, {_STRIP("list_aggregate(list_filter(string_split(s, chr(10)), lambda x: contains(x, '：') AND substr(x, 1, 1) NOT IN ('#', '[', '△')), 'string_agg', chr(10))")} s FROM sc)
SELECT doc_id, count(*) AS n, CAST(sum(least(length(s), 700)) AS BIGINT) AS chars FROM g WHERE length(s) >= 233 GROUP BY 1""")
def script_dialogues(spark, d):
    found = _scripts(spark, d).select("doc_id", F.explode(excerpts.dialogues(F.col("script"))).alias("s"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s").cast("long")).alias("chars"))


@query(f"WITH {_SCENES} SELECT doc_id, count(*) AS n, CAST(sum(least(length(s), 900)) AS BIGINT) AS chars FROM sc WHERE regexp_matches(s, 'que|und|the') GROUP BY 1")
def script_brand_scenes(spark, d):
    found = _scripts(spark, d).select("doc_id", F.explode(excerpts.brand_scenes(F.col("script"), "que|und|the")).alias("s"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s").cast("long")).alias("chars"))


_SCHEMES = (P.title, "^[A-Z][a-z]+,.*$")


def _scheme_sql(scheme):
    parts = f"(string_split(regexp_replace(text, '(?m)({scheme})', chr(1) || '\\1' || chr(2), 'g'), chr(1)))[2:]"
    bodies = f"list_transform({parts}, lambda u: {_STRIP('string_split(u, chr(2))[2]')})"
    return f"list_filter({bodies}, lambda b: length(b) >= 200)"


_BEST = f"u AS (SELECT doc_id, {_scheme_sql(_SCHEMES[0])} a, {_scheme_sql(_SCHEMES[1])} b FROM documents), best AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END x FROM u)"


@query(f"WITH {_BEST} SELECT doc_id, CAST(unnest(generate_series(1, len(x))) AS INT) AS unit, md5(unnest(x)) AS digest FROM best")
def unit_schemes(spark, d):
    found = documents(spark, d).select("doc_id", F.posexplode(excerpts.units(F.col("text"), list(_SCHEMES))).alias("i", "u"))
    return found.select("doc_id", (F.col("i") + 1).alias("unit"), F.md5("u.body").alias("digest"))


@query(f"""WITH {_BEST}, e AS (SELECT doc_id, len(x) n, unnest(generate_series(1, len(x))) i, unnest(x) b FROM best),
k AS (SELECT doc_id, i, b FROM e WHERE n <= 5 OR i <= 3 UNION ALL SELECT doc_id, i, b FROM e WHERE n > 5 AND i = n // 2 + 1 UNION ALL SELECT doc_id, i, b FROM e WHERE n > 5 AND i = n)
SELECT doc_id, md5(b) AS digest, count(*) AS n FROM k GROUP BY 1, 2""")
def unit_spread(spark, d):
    """Five of a document's units, spread over it."""
    found = documents(spark, d).select("doc_id", F.explode(excerpts.spread(excerpts.units(F.col("text"), list(_SCHEMES)), 5)).alias("u"))
    return found.groupBy("doc_id", F.md5("u.body").alias("digest")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT text, min(struct_pack(p := doc_id, a := lang)) x FROM documents WHERE length(text) >= 300 GROUP BY 1)
SELECT md5(text) AS digest, x.a AS axis, x.p AS first, x.a IS DISTINCT FROM 'de' AS other FROM f""")
def anchor_pool(spark, d):
    rows = documents(spark, d).select(F.col("text").alias("a_text"), F.col("lang").alias("axis"), F.col("doc_id").alias("position"))
    return excerpts.anchor_pool(rows, "de").select(F.md5("a_text").alias("digest"), "axis", "first", "other")


# --- Replies --------------------------------------------------------------------------------------------------

#: Replies of several shapes around the properties of an event.
_REPLY_SQL = """CASE event_id % 8 WHEN 0 THEN 'see ' || props || ' and {b}' WHEN 1 THEN 'x ```json' || chr(10) || props || chr(10) || '``` y'
WHEN 2 THEN ' {"a": ' || props || ', "b": {"c": [1]}} }} ' WHEN 3 THEN '{"a": ' || props WHEN 4 THEN 'no braces' WHEN 5 THEN '{"a": "x", ...}' WHEN 6 THEN ' [1, ' || props || ', "t", ' || props || '] ' ELSE '{"a": {...}}' END"""


def _replies(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_REPLY_SQL.replace("chr(10)", "char(10)")).alias("reply"))


@query(rf"""WITH r AS (SELECT event_id, trim({_REPLY_SQL}) b FROM events), t AS (SELECT *, substr(b, strpos(b, '{{')) s, regexp_extract(b, '(?s)```(?:json)?\s*(\{{.*?\}}|\[.*?\])\s*```', 1) f FROM r),
p AS (SELECT *, list_position(list_transform(range(1, length(s) + 1), lambda i: length(regexp_replace(substr(s, 1, i), '[^{{]', '', 'g')) - length(regexp_replace(substr(s, 1, i), '[^}}]', '', 'g'))), 0) e FROM t)
SELECT event_id, CASE WHEN f <> '' THEN f WHEN contains(b, '{{') AND coalesce(e, 0) > 0 THEN substr(s, 1, e) ELSE b END AS json FROM p""")
def json_salvage(spark, d):
    return _replies(spark, d).select("event_id", replies.salvaged_json(F.col("reply")).alias("json"))


@query(rf"""WITH r AS (SELECT event_id, {_REPLY_SQL} b FROM events)
SELECT event_id, regexp_matches(b, '^\s*[\{{\[]') AND json_valid(b) AND NOT regexp_matches(b, '{"|".join(replies.ELISIONS)}') AS accepted FROM r""")
def json_acceptance(spark, d):
    return _replies(spark, d).select("event_id", replies.accepted_json(F.col("reply")).alias("accepted"))


@query(rf"""WITH r AS (SELECT event_id, regexp_extract({_REPLY_SQL}, '(?s)\[.*\]', 0) b FROM events), j AS (SELECT event_id, CASE WHEN b <> '' AND json_valid(b) THEN json_extract(b, '$[*]') END l FROM r)
SELECT event_id, CASE WHEN len(l) = 4 THEN CAST(len(list_filter(l, lambda x: json_type(x) = 'OBJECT')) AS INT) END AS cards FROM j""")
def card_array(spark, d):
    found = replies.cards(F.col("reply"), 4)
    return _replies(spark, d).select("event_id", F.when(found.isNotNull(), F.size(found)).alias("cards"))


@query("SELECT doc_id, length(substr(text, 1, 2000)) AS vote, length(substr(text, 1, 1200)) AS packed, length(substr(text, 1, 6000)) AS annotation, md5(substr(text, 1, 1200)) AS digest FROM documents")
def prompt_limits(spark, d):
    cut = {k: replies.limited(F.col("text"), k) for k in replies.LIMITS}
    return documents(spark, d).select("doc_id", *[F.length(c).cast("long").alias(k) for k, c in cut.items()], F.md5(cut["packed"]).alias("digest"))


# --- Judging --------------------------------------------------------------------------------------------------

_SLOP = f"CASE WHEN length({_Z('text')}) > 0 THEN round(({' + '.join(f'''(length(text) - length(replace(text, '{p}', ''))) // {len(p)}''' for p in _PHRASES)}) * 1000 / length({_Z('text')}), 4) ELSE 0.0 END"
_ROUNDED = ", ".join(f"round(CAST({m} AS DOUBLE), 4) AS {m}" for m in _PENALTY)


@query(f"""WITH {CARD}, dr AS (SELECT * FROM card WHERE kind = 'drama_script'), {_bands("dr", "lang", _ROUNDED).replace("SELECT grp, metric", ", bd AS (SELECT grp, metric", 1)} WHERE grp IS NULL),
f AS (SELECT doc_id, {_SLOP} slop, {_ROUNDED} FROM card),
z AS (SELECT doc_id, slop, {" + ".join(f"(SELECT CASE WHEN {m} BETWEEN p25 AND p75 THEN 0.0 ELSE least(1.0, abs({m} - (p25 + p75) / 2) / greatest(p75 - p25, 1e-9)) END FROM bd WHERE metric = '{m}')" for m in _PENALTY)} total FROM f)
SELECT doc_id, round(greatest(0.0, 1 - total / 3 * 0.7 - least(1.0, slop / 20) * 0.3), 4) AS score FROM z""")
def deterministic_score(spark, d):
    """Off the band of the dramas, and of listed phrases: the published penalty score."""
    from corpusloom.sources.tables import written

    c = cards.cards(documents(spark, d).select("doc_id", "text"), P)
    slop = lexicon.density(F.col("text"), list(_PHRASES)).alias("slop")
    rows = written(c.select("doc_id", "kind", slop, *[F.round(F.col(m).cast("double"), 4).alias(m) for m in _PENALTY]), "scored")
    band = cards.bands(rows.where("kind = 'drama_script'"), {m: m for m in _PENALTY})
    return judging.penalty_score(rows, band, list(_PENALTY), "slop").select("doc_id", "score")


_VOTE_SQL = "SELECT user_id AS pair_id, event_id % 2 = 0 AS first_is_a, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS letter FROM events"


@query(f"WITH v AS ({_VOTE_SQL}) SELECT pair_id, count(*) AS n, avg(CAST(letter = CASE WHEN first_is_a THEN 'A' ELSE 'B' END AS INT)) AS score_a, 1 - avg(CAST(letter = CASE WHEN first_is_a THEN 'A' ELSE 'B' END AS INT)) AS score_b FROM v GROUP BY 1")
def k_sample_vote(spark, d):
    e = table(spark, d, "events")
    letter = F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B").otherwise("")
    return judging.sample_votes(e.select(F.col("user_id").alias("pair_id"), (F.col("event_id") % 2 == 0).alias("first_is_a"), letter.alias("letter")))


@query("SELECT count(*) FILTER (lang = 'en') AS excluded, count(*) FILTER (lang <> 'en' AND NOT v) AS unverified, count(*) FILTER (lang <> 'en' AND v) AS kept FROM (SELECT lang, coalesce(regexp_matches(text, '!!'), false) v FROM documents)")
def exam_filter(spark, d):
    kind = F.when(F.col("lang") == "en", judging.NOT_EXAMINED).otherwise(F.col("lang"))
    return judging.exam_counts(documents(spark, d).select(kind.alias("kind"), F.col("text").contains("!!").alias("verified")))


@query("""WITH v AS (SELECT event_type axis, user_id pair, event_id % 2 d, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END l FROM events),
p AS (SELECT axis, pair, (coalesce(avg(CAST(l = 'B' AS INT)) FILTER (d = 0), 0.5) + coalesce(avg(CAST(l = 'A' AS INT)) FILTER (d = 1), 0.5)) / 2 s FROM v GROUP BY 1, 2)
SELECT axis, count(*) AS n_pairs, round(avg(s), 4) AS score, round(avg(CAST(s > 0.5 AS INT)), 4) AS winrate, count(*) >= 6 AS enough FROM p GROUP BY 1""")
def artefact_judging(spark, d):
    letter = F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B").otherwise("")
    e = table(spark, d, "events").select(F.col("event_type").alias("axis"), F.col("user_id").alias("pair"), (F.col("event_id") % 2).alias("direction"), letter.alias("letter"))
    return judging.artefact_scores(e)


@query("""SELECT event_type AS candidate, count(*) AS n_pairs, count(*) FILTER (event_id % 7 > user_id % 7) AS wins, count(*) FILTER (event_id % 7 < user_id % 7) AS losses,
count(*) FILTER (event_id % 7 = user_id % 7) AS ties, round((count(*) FILTER (event_id % 7 > user_id % 7) + count(*) FILTER (event_id % 7 = user_id % 7) / 2) / count(*), 4) AS winrate FROM events GROUP BY 1""")
def smoke_groups(spark, d):
    return judging.smoke_groups(table(spark, d, "events").select(F.col("event_type").alias("candidate"), (F.col("event_id") % 7).alias("ours"), (F.col("user_id") % 7).alias("theirs")))


@query("SELECT CASE WHEN n <= 0 THEN '0-0' WHEN n <= 24 THEN '1-24' WHEN n <= 59 THEN '25-59' WHEN n <= 99 THEN '60-99' ELSE '100+' END AS bucket, count(*) AS n FROM (SELECT CAST(l_partkey % 130 AS INT) n FROM lineitem) GROUP BY 1")
def episode_buckets(spark, d):
    n = (F.col("l_partkey") % 130).cast("int")
    return table(spark, d, "lineitem").groupBy(judging.episode_bucket(n).alias("bucket")).agg(F.count("*").alias("n"))


@query()
def brief_draws(spark, d):
    """A brief for each order; DuckDB has no checksum to draw by, so tests hold it against plain Python."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("brief_id"))
    return judging.briefs(ids, [(10, 24, 0.25), (25, 60, 0.5), (61, 90, 0.25)], {"revenge": 2.0, "healing": 1.0, "mystery": 1.0}, ["tea house", "office", "harbour"], (1, 3), 7)


# --- Upkeep ---------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS name, coalesce('old-' || b.item_id, 'new-' || d.doc_id) AS script_id, length(d.text) AS chars, CASE WHEN b.item_id IS NOT NULL THEN 'g' || b.item_id END AS claimed_genre FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def restat(spark, d):
    fresh = documents(spark, d).select(F.col("doc_id").alias("name"), F.concat(F.lit("new-"), "doc_id").alias("script_id"), F.length("text").cast("long").alias("chars"))
    old = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.concat(F.lit("old-"), "item_id").alias("script_id"), F.concat(F.lit("g"), "item_id").alias("claimed_genre"))
    return upkeep.restat(fresh, old)


@query("SELECT l.doc_id, l.quality, length(d.text) AS chars FROM labels l JOIN documents d USING (doc_id)")
def cards_with_texts(spark, d):
    return upkeep.with_texts(table(spark, d, "labels"), documents(spark, d).select("doc_id", "text"), "doc_id").select("doc_id", "quality", F.length("text").cast("long").alias("chars"))


@query("SELECT page_id FROM pages WHERE (starts_with(url, 'https://www') OR starts_with(url, 'http://m.')) AND NOT ends_with(url, '.gitkeep')")
def forbidden_paths(spark, d):
    return upkeep.forbidden_paths(table(spark, d, "pages"), ["https://www", "http://m."], "url").select("page_id")


@query("""WITH m AS (SELECT p_partkey r, trim(p_name) p FROM part) SELECT phrase, min(place) AS place FROM
(SELECT -2 place, 'seed one' phrase UNION ALL SELECT -1, (SELECT min(trim(p_name)) FROM part) UNION ALL SELECT r, p FROM m WHERE p <> '') GROUP BY 1""")
def lexicon_merge(spark, d):
    part = table(spark, d, "part")
    least = part.agg(F.min(F.trim("p_name"))).first()[0]
    mined = part.select(F.col("p_name").alias("phrase"), F.col("p_partkey").alias("rank"))
    return upkeep.merged_lexicon(["seed one", least], mined)
