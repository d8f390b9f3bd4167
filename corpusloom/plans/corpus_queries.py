"""Queries of intake in batches, leak index, seal, apportioned samples, digests and nested texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import nested as nested_works
from corpusloom.operators import annotation, cards, digest, exam, leakindex, linewise, nearindex, ranking, seal
from corpusloom.plans import catalogue as C
from corpusloom.plans.catalogue import P, documents, query
from corpusloom.sources.tables import shared_dir, written

#: The sequential scan: who is near an earlier document that was kept is dropped, in the order of n.
_SCAN = """near AS (SELECT b.n, list(a.n ORDER BY a.n) nb FROM sq a JOIN sq b ON a.n < b.n AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3 GROUP BY b.n),
cand AS (SELECT *, row_number() OVER (ORDER BY n) i FROM near),
scan AS (SELECT CAST(0 AS BIGINT) i, CAST([] AS BIGINT[]) gone, CAST(NULL AS BIGINT) n, CAST(NULL AS BIGINT) first_kept
 UNION ALL SELECT c.i, CASE WHEN len(list_filter(c.nb, lambda x: NOT list_contains(s.gone, x))) > 0 THEN list_append(s.gone, c.n) ELSE s.gone END, c.n, list_filter(c.nb, lambda x: NOT list_contains(s.gone, x))[1]
 FROM scan s JOIN cand c ON c.i = s.i + 1)"""
_SEQUENCE = lambda order: f"sq AS (SELECT row_number() OVER (ORDER BY {order}) n, doc_id, CAST('0x' || substr(hex, 1, 8) AS BIGINT) hi, CAST('0x' || substr(hex, 9, 8) AS BIGINT) lo FROM sim)"

C.SQL["dedup_keep"] = f"""WITH RECURSIVE {C._SIM_WHOLE}, {_SEQUENCE("doc_id")}, {_SCAN}
SELECT sq.doc_id, o.doc_id AS duplicate_of FROM sq LEFT JOIN scan USING (n) LEFT JOIN sq o ON o.n = scan.first_kept"""


@query(f"""WITH RECURSIVE {C._SIM_WHOLE}, {_SEQUENCE("doc_id % 2, doc_id")}, {_SCAN}
SELECT sq.doc_id, CAST(sq.doc_id % 2 AS INT) AS batch, o.doc_id AS duplicate_of FROM sq LEFT JOIN scan USING (n) LEFT JOIN sq o ON o.n = scan.first_kept""")
def dedup_two_batches(spark, d):
    """All documents in two batches through the index: the second meets what the first left there."""
    prints = written(C._prints(spark, d), "prints")
    index = nearindex.NearIndex(spark, f"{shared_dir(spark)}/near-index-{uuid.uuid4().hex}", bands=16)
    parts = [index.admit(prints.where(F.col("id") % 2 == b), b).withColumn("batch", F.lit(b)) for b in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col("id").alias("doc_id"), "batch", "duplicate_of")


# --- Leak index and seal ----------------------------------------------------------------------------------------

_BENCH = f"""ix AS (SELECT DISTINCT w FROM (SELECT substr(text, i, 50) w FROM (SELECT text, unnest(range(1, length(text) - 48, 25)) i FROM benchmark WHERE length(text) >= 50)) WHERE regexp_matches(w, '[{P.letter}]')),
f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'tests/fixtures/' ELSE 'work/' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.md' ELSE '.txt' END path, replace(text, chr(13) || chr(10), chr(10)) t FROM documents),
x AS (SELECT path, t, starts_with(path, 'tests/fixtures/') OR ends_with(path, '.png') OR coalesce(length(t) < 50, true) exempt FROM f),
pw AS (SELECT path, substr(t, i, 50) w FROM (SELECT path, t, unnest(range(1, length(t) - 48)) i FROM x WHERE NOT exempt)),
h AS (SELECT path, count(*) hits FROM pw JOIN ix USING (w) GROUP BY path)"""


@query(f"WITH {_BENCH} SELECT path, coalesce(hits, 0) AS hits, exempt, coalesce(hits, 0) > 0 AS leaked FROM x LEFT JOIN h USING (path)")
def leak_guard(spark, d):
    """Documents as files against an index of the benchmark's items, half of which changed since the index was made."""
    items = C.table(spark, d, "benchmark").select(F.concat(F.lit("corpus/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.length("text").alias("size"), "text")
    index = leakindex.LeakIndex(spark, f"{shared_dir(spark)}/leak-index-{uuid.uuid4().hex}", P, parts=16)
    index.refresh(items.select("path", "size", F.lit(1).alias("mtime"), F.when(F.crc32("path") % 2 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text")))
    index.refresh(items.select("path", "size", F.when(F.crc32("path") % 2 == 0, 2).otherwise(1).alias("mtime"), "text"))
    i = F.col("doc_id")
    path = F.concat(F.when(i % 11 == 0, "tests/fixtures/").otherwise("work/"), i.cast("string"), F.when(i % 4 == 0, ".png").when(i % 4 == 1, ".md").otherwise(".txt"))
    return leakindex.verdicts(documents(spark, d).select(path.alias("path"), "text"), index)


_HMAC = lambda key, m: f"sha256(unhex('{bytes(b ^ 0x5C for b in key.ljust(64, bytes(1))).hex()}' || sha256(unhex('{bytes(b ^ 0x36 for b in key.ljust(64, bytes(1))).hex()}' || hex(encode({m}))))))"
_LINES_OF = lambda rows: f"SELECT part, sha256(string_agg(path || chr(0) || sha256, chr(10) ORDER BY hex(encode(path || chr(0) || sha256)))) d FROM (SELECT *, CAST('0x' || substr(sha256(path), 1, 8) AS BIGINT) % 64 part FROM {rows}) GROUP BY part"


@query(f"""WITH m AS (SELECT 'doc/' || doc_id path, sha256(text) sha256 FROM documents WHERE text IS NOT NULL), g AS ({_LINES_OF("m")}),
t AS (SELECT sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) digest FROM g)
SELECT digest, {_HMAC(b"key of the seal", "digest")} AS mac, true AS lock_ok, (SELECT count(*) FROM m WHERE path LIKE '%7') AS changes, (SELECT count(*) FROM m WHERE path LIKE '%7') = 0 AS ok FROM t""")
def sealed_manifest(spark, d):
    """The manifest of all documents under a key, and its check after the documents whose id ends in 7 were changed."""
    docs = documents(spark, d).where("text IS NOT NULL").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    locked = written(docs.select("path", F.sha2("text", 256).alias("sha256")), "manifest")
    now = docs.select("path", F.sha2(F.when(F.col("path").endswith("7"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    lock = seal.seal(locked, b"key of the seal", 64).first()
    checked = seal.verify(now, locked, lock["mac"], b"key of the seal", 64)
    return checked.select(F.lit(lock["digest"]).alias("digest"), F.lit(lock["mac"]).alias("mac"), "lock_ok", "changes", "ok")


# --- Ranking, quota, samples ------------------------------------------------------------------------------------

_CONTESTS = """it AS (SELECT DISTINCT event_type g, user_id % 12 i FROM events), pv AS (SELECT g, i j, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(i AS VARCHAR)), i) r FROM it),
cp AS (SELECT event_type g, user_id % 12 i, j, CASE WHEN value > 60 THEN 1.0 WHEN value > 40 THEN 0.5 ELSE 0.0 END w FROM events JOIN pv ON g = event_type AND r = event_id % 2 + 1 WHERE user_id % 12 <> j),
bo AS (SELECT g, i, j, w FROM cp UNION ALL SELECT g, j, i, 1 - w FROM cp), pr AS (SELECT g, i, j, count(*) n, sum(w) w FROM bo GROUP BY 1, 2, 3),
pl AS (SELECT g, i, sum(w) w, sum(n) n, row_number() OVER (PARTITION BY g ORDER BY i) k FROM pr GROUP BY g, i),
ed AS (SELECT p.g, a.k a, b.k b, p.n FROM pr p JOIN pl a ON p.g = a.g AND p.i = a.i JOIN pl b ON p.g = b.g AND p.j = b.i),
mt AS (SELECT pl.g, list(i ORDER BY k) names, list(CAST(w AS DOUBLE) ORDER BY k) won, list(pl.n ORDER BY k) games FROM pl GROUP BY pl.g),
el AS (SELECT g, list(struct_pack(a := a, b := b, n := n)) e FROM ed GROUP BY g),
fit AS (SELECT mt.g, names, won, games, e, 0 it, list_transform(won, lambda x: CAST(1 AS DOUBLE)) s FROM mt JOIN el USING (g)
 UNION ALL SELECT g, names, won, games, e, it + 1, list_transform(s, lambda x: x * exp(list_sum(list_transform(s, lambda y: 0.5 - y / (y + 1))) / list_sum(list_transform(s, lambda y: y / ((y + 1) * (y + 1)))))) FROM (SELECT g, names, won, games, e, it, list_transform(range(1, len(s) + 1), lambda k: (won[k] + 0.5) / (list_sum(list_transform(list_filter(e, lambda x: x.a = k), lambda x: x.n / (s[x.a] + s[x.b]))) + 1.0 / (s[k] + 1))) s FROM fit WHERE it < 150))"""


def _contests(spark, d):
    events = C.table(spark, d, "events").select(F.col("event_type").alias("g"), (F.col("user_id") % 12).alias("i"), "event_id", "value")
    met = ranking.pivot_pairs(events, "g", "i").select("g", "rival").distinct()
    slot = F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.col("rival").cast("string")), "rival")) - 1
    pivots = met.select("g", "rival", slot.alias("slot"))
    share = F.when(F.col("value") > 60, 1.0).when(F.col("value") > 40, 0.5).otherwise(0.0)
    return events.withColumn("slot", F.col("event_id") % 2).join(pivots, ["g", "slot"]).select("g", "i", "rival", share.alias("share"))


@query(f"WITH RECURSIVE {_CONTESTS} SELECT g AS event_type, unnest(names) AS item, round(ln(unnest(s)), 4) AS strength, unnest(games) AS n FROM fit WHERE it = 150")
def contest_strengths(spark, d):
    """Users in twelve groups, compared with the two pivots of their event type."""
    fit = ranking.strengths(_contests(spark, d), "g", "i", "rival", "share")
    return fit.select(F.col("g").alias("event_type"), "item", F.round("strength", 4).alias("strength"), "n")


@query(f"WITH RECURSIVE {_CONTESTS}, a AS (SELECT g, unnest(names) item, unnest(s) s FROM fit WHERE it = 150) SELECT g AS event_type, item FROM a QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(ln(s), 6) DESC, item) = 1")
def contest_best(spark, d):
    return ranking.select_best(_contests(spark, d), "g", "i", "rival", "share").select(F.col("g").alias("event_type"), "item")


@query("""WITH r AS (SELECT event_id, strftime(ts, '%G-W%V') AS round, row_number() OVER (PARTITION BY strftime(ts, '%G-W%V') ORDER BY ts, event_id) AS place FROM events WHERE ts IS NOT NULL)
SELECT event_id, round, place, place <= 20 AS admitted FROM r UNION ALL SELECT event_id, NULL, NULL, false FROM events WHERE ts IS NULL""")
def quota_admission(spark, d):
    return exam.admitted(C.table(spark, d, "events").select("event_id", "ts"), "event_id").select("event_id", "round", "place", "admitted")


@query("""WITH s AS (SELECT o_orderpriority p, o_orderstatus q, count(*) n, count(*) OVER () st, sum(count(*)) OVER () tot FROM orders GROUP BY 1, 2),
w AS (SELECT *, (least(100, tot) - st) * (n - 1) // greatest(tot - st, 1) whole, (least(100, tot) - st) * (n - 1) % greatest(tot - st, 1) rem FROM s),
g AS (SELECT p, q, CASE WHEN st >= 100 THEN CAST(row_number() OVER (ORDER BY n DESC, p, q) <= 100 AS INT) ELSE 1 + whole + CAST(row_number() OVER (ORDER BY rem DESC, n DESC, p, q) <= least(100, tot) - st - sum(whole) OVER () AS INT) END give FROM w),
r AS (SELECT o_orderpriority p, o_orderstatus q, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) r FROM orders)
SELECT p AS priority, q AS status, o_orderkey AS id FROM r JOIN g USING (p, q) WHERE r <= give""")
def apportioned_sample(spark, d):
    rows = C.table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))
    return exam.stratified_exact(rows, ["priority", "status"], "id", 100)


# --- Annotation cards -------------------------------------------------------------------------------------------

#: A card of each event, in the words of annotators; some fields are empty, some tensions missing.
_CARD_COLUMNS = (
    "user_id AS unit", "event_id AS seen", "CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) % 5 + 1 AS INT) END AS tension",
    "CASE event_id % 5 WHEN 0 THEN 'Threat' WHEN 1 THEN 'promise' WHEN 2 THEN 'none' WHEN 3 THEN 'inversion' END AS hook_type",
    "CASE user_id % 3 WHEN 0 THEN 'reveal' WHEN 1 THEN 'danger' ELSE '' END AS cliffhanger", "CASE WHEN value > 30 THEN 'person' ELSE 'self' END AS conflict_type",
    "event_type AS info_gap", "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS scene_turn", "props AS stakes", "CAST(NULL AS STRING) AS reversals", "CONCAT('seen ', event_id) AS summary",
)
_CARD_SQL = "cd AS (SELECT " + ", ".join(_CARD_COLUMNS) + " FROM events)"


def _annotated(spark, d):
    return C.table(spark, d, "events").select(*[F.expr(c) for c in _CARD_COLUMNS])


_MODES = ", ".join(f"coalesce(max(CASE WHEN field = '{f}' THEN value END), '') AS {f}" for f in annotation.CATEGORIES)


@query(f"""WITH {_CARD_SQL}, t AS (SELECT unit, coalesce(tension, 0) tension, seen, stakes, reversals, summary FROM cd),
md AS (SELECT unit, count(*) n, list_sort(list(tension))[count(*) // 2 + 1] tension FROM t GROUP BY unit),
tx AS (SELECT t.* FROM t JOIN md USING (unit, tension) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY seen) = 1),
u AS (SELECT unit, seen, unnest([{", ".join(f"struct_pack(field := '{f}', value := lower(trim(coalesce({f}, ''))))" for f in annotation.CATEGORIES)}], recursive := true) FROM cd),
c AS (SELECT unit, field, value, count(*) c, min(seen) first FROM u WHERE value <> '' GROUP BY 1, 2, 3),
b AS (SELECT unit, field, value FROM c QUALIFY row_number() OVER (PARTITION BY unit, field ORDER BY c DESC, first) = 1), m AS (SELECT unit, {_MODES} FROM b GROUP BY unit)
SELECT unit, n, tension, {", ".join(f"coalesce({f}, '') AS {f}" for f in annotation.CATEGORIES)}, stakes, reversals, summary FROM md JOIN tx USING (unit, tension) LEFT JOIN m USING (unit)""")
def majority_cards(spark, d):
    return annotation.majority_card(_annotated(spark, d), "unit", "seen")


_SAME = " + ".join(f"CAST(lower(trim(coalesce(a.{f}, ''))) = lower(trim(coalesce(b.{f}, ''))) AS INT)" for f in annotation.CATEGORIES)


@query(f"""WITH {_CARD_SQL}, b AS (SELECT * REPLACE (CASE WHEN seen % 4 <> 0 THEN upper(hook_type) ELSE 'x' END AS hook_type, CASE WHEN seen % 13 <> 0 THEN tension + seen % 3 END AS tension) FROM cd),
j AS (SELECT a.tension IS NOT NULL AND b.tension IS NOT NULL r, CAST(abs(a.tension - b.tension) <= 1 AS INT) + {_SAME} s FROM cd a JOIN b ON a.seen = b.seen),
o AS (SELECT count(*) n, round(count(*) FILTER (r) / count(*), 4) valid, round(sum(s) FILTER (r) / (6 * count(*) FILTER (r)), 4) rate FROM j)
SELECT n, valid, rate, rate >= 0.7 AND valid >= 0.7 AS pass FROM o""")
def card_agreement(spark, d):
    a = _annotated(spark, d)
    b = a.withColumn("hook_type", F.when(F.col("seen") % 4 != 0, F.upper("hook_type")).otherwise("x")).withColumn("tension", F.when(F.col("seen") % 13 != 0, F.col("tension") + F.col("seen") % 3))
    return annotation.card_agreement(a, b, "seen")


@query("""SELECT CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'other' END AS genre, count(*) AS n, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr')) AS fell_back FROM documents GROUP BY 1""")
def genre_distribution(spark, d):
    return annotation.genre_distribution(documents(spark, d), "lang", ["en", "de", "fr"], "other")


_RATES = "avg(CAST(lower(coalesce(hook_type, '')) IN ('threat', 'promise', 'inversion') AS INT)) hook_attack, avg(CAST(conflict_type = 'person' AS INT)) conflict_person, avg(CAST(coalesce(info_gap, '') <> 'none' AS INT)) info_gap, avg(CAST(cliffhanger IN ('reveal', 'danger') AS INT)) cliffhanger_rd, avg(CAST(scene_turn = 'true' AS INT)) scene_turn"
_SHOWN = ", ".join(f"round({k}, 3) AS {k}" for k in annotation.MIXED)


@query(f"WITH {_CARD_SQL}, r AS (SELECT count(*) n, {_RATES} FROM cd) SELECT n, {_SHOWN}, round({' + '.join(f'least(1.0, {k} / {a}) * {w}' for k, (a, w) in annotation.MIXED.items())}, 4) AS score FROM r WHERE n > 0")
def craft_mixed(spark, d):
    return annotation.craft_score(_annotated(spark, d))


_BY_TYPE = {k: round(a - 0.2, 2) for k, (a, _) in annotation.MIXED.items()}


@query(f"WITH {_CARD_SQL}, r AS (SELECT unit % 5 AS genre, count(*) n, {_RATES} FROM cd WHERE unit IS NOT NULL GROUP BY 1) SELECT genre, n, {_SHOWN}, round({' + '.join(f'least(1.0, {k} / ({_BY_TYPE[k]} + genre / 10.0)) * {w}' for k, (_, w) in annotation.MIXED.items())}, 4) AS score FROM r")
def craft_by_genre(spark, d):
    """Five groups of users as genres, each with anchors of its own."""
    rows = _annotated(spark, d).withColumn("genre", F.col("unit") % 5)
    anchors = rows.select("genre").distinct().select("genre", *[(F.lit(a) + F.col("genre") / 10.0).alias(k) for k, a in _BY_TYPE.items()])
    return annotation.craft_score(rows, ["genre"], anchors)


@query(f"WITH {C._VOTES} SELECT axis, count(*) AS n_votes, count(*) FILTER (letter = '') AS n_abstain FROM vt GROUP BY axis")
def exam_abstentions(spark, d):
    return exam.abstentions(C._votes(spark, d))


@query(f"WITH e AS ({C.SQL['exam_votes_axis']}) SELECT count(*) AS n_axes, count(*) FILTER (pass) AS n_passed, count(*) > 0 AND count(*) FILTER (pass) = count(*) AS pass FROM e")
def exam_overall(spark, d):
    return exam.overall(exam.axis_metrics(C._votes(spark, d)))


# --- Texts by line, digests, nested works -----------------------------------------------------------------------

_MARKED = "replace(replace(text, '. ', '呢啊。' || chr(10) || '甲:'), ', ', '{mark}' || chr(10))"
_RAW = lambda t: f"regexp_split_to_array({t}, '{C.LINE_BREAK}')"


def _marked(spark, d, mark):
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("呢啊。\n甲:")), F.lit(", "), F.lit(f"{mark}\n"))
    return documents(spark, d).where("text IS NOT NULL").select("doc_id", text.alias("text"))


def _shown(rows, changed):
    return rows.select("doc_id", F.length(changed).cast("long").alias("chars"), F.md5(changed).alias("digest"), (changed != F.col("text")).alias("changed"))


#: A final break opens no line.
_ROWS_OF = f"list_filter({_RAW('t')}, lambda s, i: s <> '' OR i < len({_RAW('t')}))"


@query(f"""WITH x AS (SELECT doc_id, {_MARKED.format(mark=linewise.PAYOFF)} t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, t, CASE WHEN contains(t, '{linewise.PAYOFF}') THEN array_to_string(list_filter({_ROWS_OF}, lambda s: NOT contains(s, '{linewise.PAYOFF}')), chr(10)) ELSE t END c FROM x)
SELECT doc_id, length(c) AS chars, md5(c) AS digest, c <> t AS changed FROM y""")
def degrade_setup_cut(spark, d):
    rows = _marked(spark, d, linewise.PAYOFF)
    return _shown(rows, linewise.setup_cut(F.col("text")))


@query(f"""WITH x AS (SELECT doc_id, {_MARKED.format(mark='啦')} t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, t, array_to_string(list_transform({_ROWS_OF}, lambda s: CASE WHEN regexp_matches({C._STRIP('s')}, '{linewise.SPOKEN}') THEN regexp_replace(s, '[{linewise.PARTICLES}]+([!?。！？]{{0,2}}[{C.SPACE}]*)$', '\\1') ELSE s END), chr(10)) c FROM x)
SELECT doc_id, length(c) AS chars, md5(c) AS digest, c <> t AS changed FROM y""")
def degrade_formalize(spark, d):
    rows = _marked(spark, d, "啦")
    return _shown(rows, linewise.formalized(F.col("text")))


@query(f"""WITH x AS (SELECT doc_id, {_MARKED.format(mark='品牌')} t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, t, length({C._Z('t')}) * 0.3 most, list_prepend(struct_pack(o := CAST([] AS VARCHAR[]), c := 0, v := false), list_transform({_ROWS_OF}, lambda s: struct_pack(o := [s], c := CAST(length({C._Z('s')}) AS INT), v := regexp_matches(s, '{linewise.BRAND.pattern}')))) ls FROM x),
r AS (SELECT doc_id, t, list_reduce(ls, lambda a, s: CASE WHEN s.v AND a.c + s.c <= most THEN struct_pack(o := a.o, c := a.c + s.c, v := true) ELSE struct_pack(o := list_concat(a.o, s.o), c := a.c, v := a.v) END) z FROM l),
y AS (SELECT doc_id, t, CASE WHEN z.v THEN array_to_string(z.o, chr(10)) ELSE t END c FROM r)
SELECT doc_id, length(c) AS chars, md5(c) AS digest, c <> t AS changed FROM y""")
def degrade_brand_lines(spark, d):
    """Brand lines go in their order, as long as three tenths of the text aren't exceeded."""
    rows = _marked(spark, d, "品牌")
    return _shown(rows, linewise.deleted_within_budget(F.col("text"), linewise.is_brand))


_LISTS = "regexp_extract_all(lower(text), '[a-z]{6,8}') beats, regexp_extract_all(text, '[A-Z][a-z]+') hooks, regexp_extract_all(text, '[a-z]+[.]') reversals"


@query(f"""WITH a AS (SELECT {_LISTS} FROM documents), u AS (SELECT 'beats' kind, unnest(beats) item FROM a UNION ALL SELECT 'hooks', unnest(hooks) FROM a UNION ALL SELECT 'reversals', unnest(reversals) FROM a),
c AS (SELECT kind, item, count(*) n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, item) AS rank FROM c)
SELECT kind, item, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= CASE kind WHEN 'beats' THEN 30 ELSE 20 END""")
def pattern_digest(spark, d):
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    rows = documents(spark, d).select(every(F.lower("text"), "[a-z]{6,8}").alias("beats"), every(F.col("text"), "[A-Z][a-z]+").alias("hooks"), every(F.col("text"), "[a-z]+[.]").alias("reversals"))
    return digest.pattern_digest(rows)


@query(f"WITH {C.CARD} SELECT count(*) AS n, median(CASE WHEN n_episodes > 0 THEN n_episodes END) AS median FROM card")
def digest_head(spark, d):
    return digest.digest_head(cards.cards(documents(spark, d).select("text"), P), F.col("n_episodes"))


@query(f"""WITH a AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 2 = 0 THEN {C._STRIP('text')} ELSE text END, chr(10) ORDER BY CASE WHEN conv_id % 2 = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END, turn)
 FILTER (CASE WHEN conv_id % 2 = 0 THEN {C._STRIP('text')} ELSE text END <> '') t FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(t, '') AS text FROM a""")
def nested_episode_text(spark, d):
    """Works as JSON: conversations of even id as flat lines out of order, the others as two episodes, users' lines and then the others' beats."""
    rows = C.table(spark, d, "conversations").where("conv_id IS NOT NULL")
    mine = lambda keep: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), keep), lambda x: x["text"])
    flat = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("order"), "text"))))
    is_user = lambda x: F.coalesce(x["role"] == "user", F.lit(False))
    of = rows.groupBy("conv_id").agg(flat.alias("flat"), mine(is_user).alias("said"), mine(lambda x: ~is_user(x)).alias("beats"))
    none = F.lit(None).cast("array<string>")  # a null field isn't written
    episode = lambda lines, beats: F.struct(F.array(F.struct(lines.alias("lines"), beats.alias("beats"))).alias("scenes"))
    nested = F.to_json(F.struct(F.array(episode(F.col("said"), none), episode(none, F.col("beats"))).alias("episodes")))
    work = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("flat").alias("lines")))).otherwise(nested)
    return of.select("conv_id", nested_works.work_text(work).alias("text"))
