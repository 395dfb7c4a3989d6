"""Queries on play sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import plays as P
from ..operators import sequence as Q
from .grading import rounded
from .registry import query

RULES = P.Rules()
_LIVE = "type IN ('click', 'view', 'signup') AND down BETWEEN 1 AND 4 AND dist BETWEEN 1 AND 99 AND ytez BETWEEN 1 AND 99"
_RAW = "SELECT event_key, seq, type, CASE WHEN seq % 5 = 0 THEN NULL ELSE (seq // 7) * 7 END AS hs, CASE WHEN seq % 3 = 0 THEN NULL ELSE (seq // 11) * (1 + seq % 4) END AS a_s FROM play"
_RAW_SPARK = _RAW.replace("(seq // 7)", "(seq div 7)").replace("(seq // 11)", "(seq div 11)")


@query("win_1_score_values", f"""WITH r AS ({_RAW}), f AS (SELECT *, coalesce(last_value(hs IGNORE NULLS) OVER w, 0) AS nh, coalesce(last_value(a_s IGNORE NULLS) OVER w, 0) AS na,
coalesce(last_value(hs IGNORE NULLS) OVER b, 0) AS ph, coalesce(last_value(a_s IGNORE NULLS) OVER b, 0) AS pa FROM r WINDOW w AS (PARTITION BY event_key ORDER BY seq ROWS UNBOUNDED PRECEDING),
b AS (PARTITION BY event_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), c AS (SELECT *, (nh - ph) - (na - pa) AS d FROM f)
SELECT event_key, seq, ph AS prev_h, pa AS prev_a, CAST(sign(d) * CASE WHEN abs(d) <= 2 AND type LIKE '%sign%' THEN 0 WHEN abs(d) >= 6 THEN 7 WHEN abs(d) >= 3 THEN 3 ELSE abs(d) END AS BIGINT) AS score_value FROM c""")
def win_1(t):
    return P.scores(t.sql(_RAW_SPARK), away="a_s", point_after="sign|Two").select("event_key", "seq", "prev_h", "prev_a", F.col("score_value").cast("long").alias("score_value"))


@query("win_2_drive_ids", "WITH n AS (SELECT *, CASE WHEN off_side IS DISTINCT FROM lag(off_side) OVER w OR lag(1) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM play WINDOW w AS (PARTITION BY event_key ORDER BY seq)) SELECT event_key, seq, CAST(sum(c) OVER (PARTITION BY event_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive FROM n")
def win_2(t):
    return Q.islands(t["play"], ["event_key"], ["seq"], "off_side", "drive").select("event_key", "seq", "drive")


_NEXT = "SELECT *, coalesce(first_value(nullif(score_value, 0) IGNORE NULLS) OVER (PARTITION BY event_key, half ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS next_score FROM (SELECT *, CASE WHEN period <= 2 THEN 1 ELSE 2 END AS half FROM play)"


@query("win_3_next_score", f"SELECT event_key, seq, next_score FROM ({_NEXT})")
def win_3(t):
    return P.next_score(t["play"]).select("event_key", "seq", "next_score")


_PRE = "SELECT *, CASE WHEN off_side = 'A' THEN m ELSE -m END AS pre_margin FROM (SELECT *, CAST(coalesce(sum(CASE WHEN off_side = 'A' THEN score_value ELSE -score_value END) OVER (PARTITION BY event_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS m FROM play)"


@query("win_4_margin_before", f"SELECT event_key, seq, pre_margin FROM ({_PRE})")
def win_4(t):
    return P.margin_before(t["play"]).select("event_key", "seq", "pre_margin")


@query("fil_7_scrimmage", f"SELECT event_key, seq FROM play WHERE {_LIVE}")
def fil_7(t):
    return t["play"].where(P.scrimmage((*RULES.rush, *RULES.passing))).select("event_key", "seq")


@query("fil_8_garbage_time", f"SELECT event_key, seq FROM ({_PRE}) WHERE NOT ((period = 2 AND abs(pre_margin) > 38) OR (period = 3 AND abs(pre_margin) > 28) OR (period = 4 AND abs(pre_margin) > 22))")
def fil_8(t):
    return P.margin_before(t["play"]).where(~P.garbage_time(RULES)).select("event_key", "seq")


_BUCKET = "CAST(least(greatest(coalesce(down, 1), 1), 4) AS INTEGER) AS b_down, CAST(floor(least(greatest(coalesce(ytez, 75), 1), 99) / 5) AS INTEGER) AS b_field, CASE WHEN coalesce(dist, 10) <= 3 THEN 0 WHEN coalesce(dist, 10) <= 6 THEN 1 WHEN coalesce(dist, 10) <= 10 THEN 2 WHEN coalesce(dist, 10) <= 15 THEN 3 ELSE 4 END AS b_dist"


@query("sca_3_buckets", f"SELECT event_key, seq, {_BUCKET} FROM (SELECT event_key, seq, nullif(down, 4) AS down, nullif(ytez, 50) AS ytez, nullif(dist, 7) AS dist FROM play)")
def sca_3(t):
    n = t["play"].select("event_key", "seq", *(F.nullif(F.col(c), F.lit(v)).alias(c) for c, v in (("down", 4), ("ytez", 50), ("dist", 7))))
    return n.select("event_key", "seq", *P.buckets())


@query("sca_6_half", "SELECT event_key, seq, CASE WHEN period IN (1, 2) THEN 1 WHEN period IN (3, 4) THEN 2 ELSE 3 END AS half FROM play")
def sca_6(t):
    return t["play"].select("event_key", "seq", S.half_of(F.col("period")).alias("half"))


@query("sca_7_fractions", "SELECT event_key, seq, CAST(down AS DOUBLE) AS made, CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(dist AS DOUBLE) END AS tried FROM play")
def sca_7(t):
    text = F.concat(F.col("down").cast("string"), F.when(F.col("seq") % 2 == 0, "-").otherwise("/"), F.when(F.col("seq") % 4 == 0, "x").otherwise(F.col("dist").cast("string")))
    return t["play"].select("event_key", "seq", S.fraction_part(text, 0).alias("made"), S.fraction_part(text, 1).alias("tried"))


def _scored(t):
    p = P.margin_before(P.next_score(t["play"]))
    return p.where(P.scrimmage((*RULES.rush, *RULES.passing))).withColumn("next_score_off", F.col("next_score"))


_GRID = f"""s AS (SELECT * FROM ({_NEXT}) WHERE {_LIVE}), b AS (SELECT {_BUCKET}, next_score AS y FROM s), c AS (SELECT b_down, b_field, b_dist, sum(y) AS s, count(*) AS n FROM b GROUP BY 1, 2, 3), f AS (SELECT b_field, avg(y) AS m FROM b GROUP BY 1),
g AS (SELECT CAST(i % 4 + 1 AS INTEGER) AS b_down, CAST(i // 20 AS INTEGER) AS b_field, CAST((i // 4) % 5 AS INTEGER) AS b_dist FROM (SELECT range AS i FROM range(400))),
ep AS (SELECT g.*, (coalesce(c.s, 0) + 30 * coalesce(f.m, 0)) / (coalesce(c.n, 0) + 30) AS ep FROM g LEFT JOIN f USING (b_field) LEFT JOIN c USING (b_down, b_field, b_dist))"""


@query("agg_6_expected_points", f"WITH {_GRID} SELECT b_down, b_field, b_dist, round(ep, 6) AS ep FROM ep")
def agg_6(t):
    return rounded(P.expected_points(_scored(t)))


@query("join_14_grid_lookup", f"WITH {_GRID}, x AS (SELECT event_key, seq, {_BUCKET} FROM s) SELECT event_key, seq, round(ep, 6) AS ep0 FROM x JOIN ep USING (b_down, b_field, b_dist)")
def join_14(t):
    s = _scored(t)
    return rounded(P.look_up(s, P.expected_points(s), "ep0", F.col("down"), F.col("ytez"), F.col("dist")).select("event_key", "seq", "ep0"))


_EPA = f"""{_GRID}, k AS (SELECT *, lead(off_side) OVER w AS n_side, lead(down) OVER w AS n_down, lead(ytez) OVER w AS n_ytez, lead(dist) OVER w AS n_dist FROM s WINDOW w AS (PARTITION BY event_key ORDER BY seq)),
x0 AS (SELECT k.*, {_BUCKET} FROM k), x1 AS (SELECT x0.* EXCLUDE (b_down, b_field, b_dist), ep AS ep0 FROM x0 JOIN ep USING (b_down, b_field, b_dist)),
n0 AS (SELECT event_key, seq, {_BUCKET} FROM (SELECT event_key, seq, n_down AS down, n_ytez AS ytez, n_dist AS dist FROM k)), n1 AS (SELECT event_key, seq, ep AS e_same FROM n0 JOIN ep USING (b_down, b_field, b_dist)),
m0 AS (SELECT event_key, seq, {_BUCKET} FROM (SELECT event_key, seq, 1 AS down, n_ytez AS ytez, 10 AS dist FROM k)), m1 AS (SELECT event_key, seq, ep AS e_flip FROM m0 JOIN ep USING (b_down, b_field, b_dist)),
e AS (SELECT x1.*, least(greatest((CASE WHEN score_value <> 0 THEN score_value WHEN n_side = off_side AND n_ytez BETWEEN 1 AND 99 THEN e_same WHEN n_side <> off_side THEN -e_flip ELSE 0 END) - ep0, -10), 10) AS epa,
  CASE WHEN down = 1 THEN yds >= 0.5 * dist WHEN down = 2 THEN yds >= 0.7 * dist ELSE yds >= dist END AS success, type IN ('view', 'signup') AS is_pass, CASE WHEN type IN ('view', 'signup') THEN yds >= 16 ELSE yds >= 12 END AS explosive,
  type = 'signup' AS sack, coalesce(n_side <> off_side, false) AS turnover FROM x1 JOIN n1 USING (event_key, seq) JOIN m1 USING (event_key, seq))"""


def _added(t):
    s = _scored(t)
    return P.added_points(s, P.expected_points(s), RULES)


@query("sca_4_points_added", f"WITH {_EPA} SELECT event_key, seq, round(epa, 6) AS epa FROM e")
def sca_4(t):
    return rounded(_added(t).select("event_key", "seq", "epa"))


@query("sca_5_success_flags", f"WITH {_EPA} SELECT event_key, seq, CAST(success AS INTEGER) AS success, CAST(explosive AS INTEGER) AS explosive, CAST(sack AS INTEGER) AS sack, CAST(turnover AS INTEGER) AS turnover FROM e")
def sca_5(t):
    return _added(t).select("event_key", "seq", "success", "explosive", "sack", "turnover")


_I = "avg(CAST({0} AS INTEGER))"


@query("agg_1_efficiency", f"WITH {_EPA} SELECT event_key, off_side, count(*) AS plays, round(avg(epa), 6) AS epa_pp, round({_I.format('success')}, 6) AS sr, round(avg(yds), 6) AS ypp, round({_I.format('explosive')}, 6) AS expl, round({_I.format('turnover')}, 6) AS to_rate FROM e GROUP BY 1, 2")
def agg_1(t):
    return rounded(P.efficiency(_added(t), ["event_key", "off_side"]).select("event_key", "off_side", "plays", "epa_pp", "sr", "ypp", "expl", "to_rate"))


@query("agg_2_rush_pass_splits", f"WITH {_EPA} SELECT event_key, off_side, round(avg(epa) FILTER (NOT is_pass), 6) AS rush_epa, round({_I.format('success')} FILTER (NOT is_pass), 6) AS rush_sr, round(avg(epa) FILTER (is_pass), 6) AS pass_epa, round({_I.format('success')} FILTER (is_pass), 6) AS pass_sr, round({_I.format('sack')} FILTER (is_pass), 6) AS sack_rate FROM e GROUP BY 1, 2")
def agg_2(t):
    return rounded(P.efficiency(_added(t), ["event_key", "off_side"]).select("event_key", "off_side", "rush_epa", "rush_sr", "pass_epa", "pass_sr", "sack_rate"))


_DRIVES = """n AS (SELECT *, CASE WHEN off_side IS DISTINCT FROM lag(off_side) OVER w OR lag(1) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM play WINDOW w AS (PARTITION BY event_key ORDER BY seq)),
i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY event_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive, type IN ('click', 'view', 'signup') AS live FROM n),
d AS (SELECT event_key, drive, off_side, arg_min(ytez, seq) FILTER (live) AS start, min(ytez) FILTER (live) AS best, bool_or(type = 'purchase') AS td, bool_or(type = 'error') AS fg FROM i GROUP BY 1, 2, 3 HAVING min(ytez) FILTER (live) IS NOT NULL),
r AS (SELECT *, CASE WHEN td THEN 7 WHEN fg THEN 3 ELSE 0 END AS pts, best <= 40 AS opp, best <= 20 AS rz FROM d)"""


@query("agg_3_drives", f"WITH {_DRIVES} SELECT event_key, drive, off_side, start, best, td, fg, pts, opp, rz FROM r")
def agg_3(t):
    return P.drives(t["play"], RULES)


@query("agg_4_drive_summary", f"WITH {_DRIVES} SELECT event_key, off_side, count(*) AS drives, round(avg(pts), 6) AS pts_per_drive, round(avg(100 - start), 6) AS start_fp, count(*) FILTER (rz) AS rz_trips, round(avg(pts) FILTER (opp), 6) AS ppo, round(avg(CAST(td AS INTEGER)) FILTER (rz), 6) AS rz_td_rate FROM r GROUP BY 1, 2")
def agg_4(t):
    return rounded(P.drive_summary(P.drives(t["play"], RULES), ["event_key", "off_side"]))


@query("agg_5_field_goals", "SELECT event_key, off_side, count(*) AS fg_att, count(*) FILTER (yds >= 12) AS fg_made FROM play WHERE type = 'error' GROUP BY 1, 2")
def agg_5(t):
    return t["play"].where(F.col("type").isin(*RULES.kick)).groupBy("event_key", "off_side").agg(F.count("*").alias("fg_att"), F.count_if(F.col("yds") >= 12).alias("fg_made"))


@query("join_10_play_and_drive_stats", f"WITH {_DRIVES}, a AS (SELECT event_key, off_side, count(*) AS plays FROM play WHERE seq > 20 GROUP BY 1, 2), b AS (SELECT event_key, off_side, count(*) AS drives FROM r WHERE drive < 5 GROUP BY 1, 2) SELECT event_key, off_side, plays, drives FROM a FULL JOIN b USING (event_key, off_side)")
def join_10(t):
    a = t["play"].where("seq > 20").groupBy("event_key", "off_side").agg(F.count("*").alias("plays"))
    b = P.drives(t["play"], RULES).where("drive < 5").groupBy("event_key", "off_side").agg(F.count("*").alias("drives"))
    return a.join(b, ["event_key", "off_side"], "full")


@query("join_16_box_rows", "WITH e AS (SELECT DISTINCT user_id AS event_key, s AS off_side FROM events, (VALUES ('A'), ('B'), ('C')) AS v(s)), a AS (SELECT event_key, off_side, count(*) AS plays FROM play GROUP BY 1, 2), f AS (SELECT event_key, off_side, count(*) AS fg_att FROM play WHERE type = 'error' GROUP BY 1, 2) SELECT event_key, off_side, plays, coalesce(fg_att, 0) AS fg_att FROM e LEFT JOIN (FROM a FULL JOIN f USING (event_key, off_side)) USING (event_key, off_side)")
def join_16(t):
    e = t["events"].select(F.col("user_id").alias("event_key")).distinct().select("event_key", F.explode(F.array(*map(F.lit, "ABC"))).alias("off_side"))
    a = t["play"].groupBy("event_key", "off_side").agg(F.count("*").alias("plays"))
    f = t["play"].where("type = 'error'").groupBy("event_key", "off_side").agg(F.count("*").alias("fg_att"))
    return P.box_rows(e, a, f, ["event_key", "off_side"])


@query("src_5_most_attempts", "SELECT event_key, type, att FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY att DESC, place) AS k FROM (SELECT event_key, type, count(*) AS att, min(seq) AS place FROM play GROUP BY 1, 2)) WHERE k = 1")
def src_5(t):
    a = t["play"].groupBy("event_key", "type").agg(F.count("*").alias("att"), F.min("seq").alias("place"))
    return P.most_attempts(a, ["event_key"]).select("event_key", "type", "att")
