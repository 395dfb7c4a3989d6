"""Queries on contests: availability, filters, as-of joins, windows, sets, and table maintenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import availability as A
from ..operators import folds as V
from ..operators import sequence as Q
from ..operators import tables as U
from .grading import rounded
from .registry import query


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


_CUT = "TIMESTAMP '1998-06-01 00:00:00'"
CUT = "1998-06-01 00:00:00"

# --- filters


@query("fil_1_availability", "SELECT game_id, avail FROM contest_avail")
def fil_1(t):
    return A.with_availability(t["contest"], 270).select("game_id", "avail")


@query("fil_2_visible", f"SELECT game_id, avail FROM contest_avail WHERE avail <= {_CUT}")
def fil_2(t):
    return A.visible(A.with_availability(t["contest"], 270), ts(CUT)).select("game_id", "avail")


@query("fil_3_leak_check", f"SELECT count(*) AS used, count(*) FILTER (avail > {_CUT}) AS violations, max(avail) FILTER (avail > {_CUT}) AS latest FROM contest_avail WHERE kickoff <= {_CUT}")
def fil_3(t):
    return A.leaks(A.with_availability(t["contest"], 270).where(F.col("kickoff") <= ts(CUT)).withColumn("cutoff", ts(CUT)))


@query("fil_4_decided", f"SELECT game_id FROM contest_avail WHERE home_score <> away_score AND season >= 1996 AND avail <= {_CUT}")
def fil_4(t):
    a = A.with_availability(t["contest"], 270)
    return A.visible(a.where("home_score <> away_score AND season >= 1996"), ts(CUT)).select("game_id")


@query("fil_5_local_day", "SELECT game_id, CAST(timezone('America/New_York', timezone('UTC', kickoff)) - INTERVAL '5' HOUR AS DATE) AS d FROM contest")
def fil_5(t):
    return t["contest"].select("game_id", A.local_day(F.col("kickoff"), "America/New_York").alias("d"))


@query("fil_6_training_cutoff", "SELECT game_id, least(timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', kickoff))) + INTERVAL '5' HOUR)), kickoff) AS cutoff FROM contest")
def fil_6(t):
    return t["contest"].select("game_id", A.training_cutoff(F.col("kickoff")).alias("cutoff"))


@query("fil_9_unstarted", f"SELECT game_id FROM contest c WHERE kickoff > {_CUT} AND NOT EXISTS (SELECT 1 FROM contest r WHERE r.game_id = c.game_id AND r.game_id % 3 = 0)")
def fil_9(t):
    c = t["contest"]
    return c.where(F.col("kickoff") > ts(CUT)).join(c.where("game_id % 3 = 0").select("game_id"), "game_id", "left_anti").select("game_id")


@query("fil_10_exhibitions", "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_7')")
def fil_10(t):
    return t["nation"].where(~F.col("n_name").isin("NATION_1", "NATION_7")).select("n_nationkey", "n_name")


_ASK = "SELECT game_id AS query_id, away_id AS a, home_id AS b, kickoff - INTERVAL '2' DAY AS at FROM contest"


@query("fil_11_find_contest", f"""WITH q AS ({_ASK}), m AS (SELECT q.query_id, c.game_id, c.kickoff, c.home_id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.kickoff, c.game_id) AS k FROM q JOIN contest c
  ON least(q.a, q.b) = least(c.home_id, c.away_id) AND greatest(q.a, q.b) = greatest(c.home_id, c.away_id) AND c.kickoff > q.at - INTERVAL '5' HOUR AND c.kickoff <= q.at + INTERVAL '3' DAY)
SELECT query_id, game_id, kickoff, home_id FROM m WHERE k = 1""")
def fil_11(t):
    return A.find_contest(t.sql(_ASK), t["contest"], 5, 3)


@query("fil_12_subgroups", "SELECT subgroup, count(*) AS n FROM graded, (VALUES ('neutral'), ('conference')) AS s(subgroup) WHERE CASE subgroup WHEN 'neutral' THEN neutral = 1 ELSE conf_game = 1 END GROUP BY 1")
def fil_12(t):
    from ..operators.grading import melt_groups

    return melt_groups(t["graded"], {"neutral": F.col("neutral") == 1, "conference": F.col("conf_game") == 1}).groupBy("subgroup").agg(F.count("*").alias("n"))


_DIV = """d AS (SELECT season, team, count(*) AS n, avg(CASE WHEN feed_group = 80 THEN 1e0 ELSE 0 END) AS s FROM (SELECT season, home_id AS team, feed_group FROM contest
UNION ALL SELECT season, away_id, feed_group FROM contest) GROUP BY 1, 2), v AS (SELECT season, team, CASE WHEN s > 0.5 THEN 'FBS' WHEN n >= 4 THEN 'FCS' ELSE 'OTHER' END AS division FROM d)"""


@query("fil_13_divisions", f"WITH {_DIV} SELECT * FROM v")
def fil_13(t):
    return A.divisions(t["contest"])


@query("fil_14_division_fallback", f"WITH {_DIV} SELECT g.game_id, coalesce(a.division, b.division, c.division, 'OTHER') AS division FROM contest g LEFT JOIN v a ON a.season = g.season + 1 AND a.team = g.home_id LEFT JOIN v b ON b.season = g.season AND b.team = g.home_id LEFT JOIN v c ON c.season = g.season - 1 AND c.team = g.home_id")
def fil_14(t):
    rows = t["contest"].select("game_id", (F.col("season") + 1).alias("season"), F.col("home_id").alias("team"))
    return A.division_of(rows, A.divisions(t["contest"])).select("game_id", "division")


@query("fil_15_slate_flags", f"SELECT game_id, CASE WHEN kickoff <= {_CUT} THEN 'excluded: started' WHEN neutral = 1 THEN 'excluded: neutral' ELSE 'predicted' END AS status, CASE WHEN conf_game = 1 THEN 'C' || (home_id % 5) ELSE 'C' || (home_id % 5) || '/C' || (away_id % 5) END AS label FROM contest")
def fil_15(t):
    status = F.when(F.col("kickoff") <= ts(CUT), "excluded: started").when(F.col("neutral") == 1, "excluded: neutral").otherwise("predicted")
    mine, other = (F.concat(F.lit("C"), (F.col(c) % 5).cast("string")) for c in ("home_id", "away_id"))
    return t["contest"].select("game_id", status.alias("status"), F.when(F.col("conf_game") == 1, mine).otherwise(F.concat(mine, F.lit("/"), other)).alias("label"))


# --- as-of joins and counts


@query("join_5_asof_history", """SELECT c.game_id, count(o.y) AS n, round(coalesce(sum(o.margin), 0), 4) AS margin FROM contest c LEFT JOIN obs o ON o.off_id = c.home_id AND o.season = c.season AND o.avail <= c.kickoff GROUP BY c.game_id""")
def join_5(t):
    targets = t["contest"].select("game_id", "season", F.col("home_id").alias("off_id"), F.col("kickoff").alias("cutoff"))
    out = A.running_asof(targets, t["obs"].select("season", "off_id", "avail", "y", "margin"), ["off_id", "season"], {"n": lambda w: F.count("_y").over(w), "margin": lambda w: F.coalesce(F.sum("_margin").over(w), F.lit(0.0))})
    return out.select("game_id", "n", F.round("margin", 4).alias("margin"))


@query("join_5_asof_rows", "SELECT c.game_id, o.game_id AS fact, o.y FROM contest c JOIN obs o ON o.off_id = c.home_id AND o.season = c.season AND o.avail <= c.kickoff")
def join_5_rows(t):
    targets = t["contest"].select("game_id", "season", F.col("home_id").alias("off_id"), F.col("kickoff").alias("cutoff"))
    facts = t["obs"].select(F.col("game_id").alias("fact"), "season", "off_id", "avail", "y")
    return A.assert_no_leaks(A.range_asof(targets, facts, ["off_id", "season"])).select("game_id", "fact", "y")


@query("join_6_visible_counts", "WITH c AS (SELECT DISTINCT kickoff AS cutoff FROM contest) SELECT cutoff, CAST((SELECT count(*) FROM contest_avail a WHERE a.avail <= cutoff) AS BIGINT) AS visible FROM c")
def join_6(t):
    return A.visible_counts(t["contest"].select(F.col("kickoff").alias("cutoff")), t["contest_avail"])


_RATED = "SELECT season, off_id AS team, avg(margin) AS r FROM obs GROUP BY 1, 2"


@query("join_7_two_sided_lookup", f"WITH r AS ({_RATED}) SELECT c.game_id, round(h.r, 6) AS r_home, round(a.r, 6) AS r_away FROM contest c LEFT JOIN r h ON h.season = c.season AND h.team = c.home_id LEFT JOIN r a ON a.season = c.season AND a.team = c.away_id")
def join_7(t):
    from ..operators.features import both_sides

    r = t["obs"].groupBy("season", F.col("off_id").alias("team")).agg(F.avg("margin").alias("r"))
    return rounded(both_sides(t["contest"], r, ["season"], ["r"]).select("game_id", "r_home", "r_away"))


@query("join_8_features_targets", "SELECT c.game_id, c.home_score - c.away_score AS margin, c.home_score + c.away_score AS total, CAST(c.home_score > c.away_score AS INTEGER) AS home_win FROM contest c JOIN prediction p ON p.game_id = c.game_id AND p.model_version = 'v1.0'")
def join_8(t):
    from ..operators.features import with_targets

    return with_targets(t["prediction"].where("model_version = 'v1.0'").select("game_id"), t["contest"]).select("game_id", "margin", "total", "home_win")


@query("join_9_metadata", "WITH f AS (SELECT game_id, kickoff - INTERVAL '1' HOUR AS cutoff, 1 AS x FROM contest UNION ALL SELECT game_id, kickoff - INTERVAL '2' HOUR, 2 FROM contest), m AS (SELECT game_id, kickoff - INTERVAL '1' HOUR AS cutoff, season FROM contest) SELECT f.game_id, x, season FROM f LEFT JOIN m ON f.game_id = m.game_id AND f.cutoff = m.cutoff")
def join_9(t):
    at = lambda h: (F.col("kickoff") - A.minutes(60 * h)).alias("cutoff")
    f = t["contest"].select("game_id", at(1), F.lit(1).alias("x")).unionByName(t["contest"].select("game_id", at(2), F.lit(2).alias("x")))
    return f.join(t["contest"].select("game_id", at(1), "season"), ["game_id", "cutoff"], "left").select("game_id", "x", "season")


@query("join_12_opponent", "SELECT a.game_id, a.team_id, b.team_id AS opponent, round(b.return_rate, 6) AS takeaways FROM entity_stats a JOIN entity_stats b ON a.game_id = b.game_id AND a.team_id <> b.team_id")
def join_12(t):
    other = t["entity_stats"].select("game_id", F.col("team_id").alias("opponent"), F.col("return_rate").alias("takeaways"))
    return rounded(t["entity_stats"].select("game_id", "team_id").join(other, "game_id").where("team_id <> opponent"))


@query("join_13_row_alignment", "SELECT pred_id, game_id, home_score FROM (SELECT p.pred_id, p.game_id, c.home_score FROM prediction p JOIN contest c USING (game_id))")
def join_13(t):
    asked = t["prediction"].select("pred_id", "game_id")
    return asked.join(t["contest"].select("game_id", "home_score"), "game_id").select("pred_id", "game_id", "home_score")


#: Teams with five names, of which some are shared or missing; aliases; and names asked for, in other letters, with other first letters, and wrong ones.
_TEAMS = """SELECT s_suppkey AS team_id, p_name AS location, p_name || ' ' || p_brand AS display_name, upper(left(p_name, 1)) || CAST(s_suppkey AS VARCHAR(9)) AS abbr,
  CASE WHEN s_suppkey % 3 <> 0 THEN split_part(p_name, ' ', 2) || ' ' || CAST(s_suppkey AS VARCHAR(9)) END AS short_name, p_brand AS name FROM supplier JOIN part ON p_partkey = s_suppkey"""
_ALIASES = "SELECT n_name AS alias, p_name || ' ' || p_brand AS name FROM nation JOIN part ON p_partkey = n_nationkey"
_ASKED = """SELECT CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'i', 'y') WHEN 2 THEN 'x' || substr(p_name, 2) WHEN 3 THEN p_name || ', ' || p_brand
  WHEN 4 THEN substr(p_name, 2) || ' ' || p_type ELSE split_part(p_name, ' ', 2) || '  ' || CAST(p_partkey AS VARCHAR(9)) END AS asked FROM part UNION ALL SELECT lower(n_name) FROM nation"""
_POPULAR = "SELECT team AS team_id, count(*) AS n FROM (SELECT home_id AS team FROM contest WHERE feed_group = 80 UNION ALL SELECT away_id FROM contest WHERE feed_group = 80) GROUP BY 1"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9&()]+', ' ', 'g'))"


@query("join_15_entity_resolution", f"""WITH t AS ({_TEAMS}), pop AS ({_POPULAR}), al AS (SELECT {_normal("alias")} AS q, min({_normal("name")}) AS target FROM ({_ALIASES}) GROUP BY 1),
a AS (SELECT asked, coalesce(target, nq) AS q FROM (SELECT DISTINCT asked, {_normal("asked")} AS nq FROM ({_ASKED})) LEFT JOIN al ON al.q = nq),
f AS (SELECT team_id, {_normal("location")} AS name, 0 AS rank FROM t UNION ALL {" UNION ALL ".join(f"SELECT team_id, {_normal(c)}, 1 FROM t" for c in ("display_name", "abbr", "short_name", "name"))}),
n AS (SELECT f.team_id, f.name, f.rank, coalesce(pop.n, 0) AS n FROM f LEFT JOIN pop USING (team_id) WHERE name <> ''),
x AS (SELECT q, team_id, 'exact' AS how, name, 1e0 AS score, row_number() OVER (PARTITION BY q ORDER BY rank, n DESC, team_id) AS k FROM (SELECT DISTINCT q FROM a) JOIN n ON name = q),
p AS (SELECT q, name, 1 - levenshtein(q, name) / greatest(length(q), length(name)) AS score FROM (SELECT DISTINCT q FROM a WHERE q NOT IN (SELECT q FROM x)) CROSS JOIN (SELECT DISTINCT name FROM n)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, name) AS k FROM p WHERE score >= 0.75) WHERE k = 1),
z AS (SELECT q, team_id, 'fuzzy' AS how, b.name, score, row_number() OVER (PARTITION BY q ORDER BY n DESC, team_id) AS k FROM b JOIN n ON n.name = b.name),
r AS (SELECT * FROM x WHERE k = 1 UNION ALL SELECT * FROM z WHERE k = 1)
SELECT asked, team_id AS entity, coalesce(how, 'none') AS how, name, round(score, 6) AS score FROM a LEFT JOIN r USING (q)""")
def join_15(t):
    """The popularity of AGG-26 decides between teams of equal names."""
    from ..operators.resolve import resolve

    return rounded(resolve(t.sql(_ASKED), t.sql(_TEAMS), t.sql(_POPULAR), t.sql(_ALIASES)))


# --- windows


def _sides(t):
    return t["obs"].select("game_id", "season", "kickoff", "avail", F.col("off_id").alias("team"), "margin", F.col("y"))


@query("win_5_form3", "SELECT game_id, off_id AS team, round(avg(margin) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS form3 FROM obs")
def win_5(t):
    return rounded(Q.form(_sides(t), "margin", "form3", 3, ["team", "season"], ["kickoff", "game_id"]).select("game_id", "team", "form3"))


@query("win_6_form5", "SELECT game_id, off_id AS team, round(avg(margin) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form5 FROM obs")
def win_6(t):
    return rounded(Q.form(_sides(t), "margin", "form5", 5, ["team", "season"], ["kickoff", "game_id"]).select("game_id", "team", "form5"))


@query("win_7_rest_days", """SELECT game_id, off_id AS team, CAST(least(coalesce(floor(epoch(kickoff - lag(kickoff) OVER w) / 86400), 14), 21) AS BIGINT) AS rest,
count(*) OVER (PARTITION BY off_id, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM obs WINDOW w AS (PARTITION BY off_id, season ORDER BY kickoff, game_id)""")
def win_7(t):
    return Q.rest_days(_sides(t), "kickoff", ["team", "season"], ["kickoff", "game_id"]).select("game_id", "team", "rest", "prior")


_STARTER = "SELECT game_id, season, kickoff, off_id AS team, def_id % 3 AS qb, y FROM obs"


@query("win_8_starter_share", f"""WITH s AS ({_STARTER}) SELECT game_id, team, round(CASE WHEN sum(y) OVER w > 0 THEN sum(y) OVER q / sum(y) OVER w ELSE 1 END, 6) AS share, coalesce(CAST(qb <> lag(qb) OVER w AS INTEGER), 0) AS changed FROM s
WINDOW w AS (PARTITION BY team, season ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY team, season, qb ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING)""")
def win_8(t):
    return rounded(Q.starter_share(t.sql(_STARTER), ["team", "season"], ["kickoff", "game_id"], "qb", "y").select("game_id", "team", "share", "changed"))


@query("agg_29_attempts_to_date", f"WITH s AS ({_STARTER}) SELECT game_id, team, qb, sum(y) OVER (PARTITION BY team, season, qb ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING) AS attempts FROM s")
def agg_29(t):
    w = W.partitionBy("team", "season", "qb").orderBy("kickoff", "game_id").rowsBetween(W.unboundedPreceding, 0)
    return t.sql(_STARTER).select("game_id", "team", "qb", F.sum("y").over(w).alias("attempts"))


@query("win_9_latest_rows", "SELECT team, game_id FROM (SELECT off_id AS team, game_id, row_number() OVER (PARTITION BY off_id ORDER BY kickoff DESC, game_id DESC) AS k FROM obs) WHERE k <= 2")
def win_9(t):
    return Q.latest_rows(_sides(t), ["team"], [F.desc("kickoff"), F.desc("game_id")], 2).select("team", "game_id")


_WINDOW = "w AS (SELECT * FROM contest_avail ORDER BY kickoff DESC, game_id DESC LIMIT least(3000, CAST(floor((SELECT count(*) FROM contest) * 0.45) AS INTEGER))), b AS (SELECT *, CAST(ntile(6) OVER (ORDER BY kickoff, game_id) - 1 AS INTEGER) AS fold FROM w)"


@query("win_11_folds", f"""WITH {_WINDOW}, s AS (SELECT fold, min(kickoff) AS start, count(*) AS n_test FROM b GROUP BY 1)
SELECT fold, start, n_test, (SELECT count(*) FROM contest_avail a WHERE a.avail <= start) AS n_train FROM s""")
def win_11(t):
    rows = t["contest_avail"]
    return V.training_sizes(rows, V.folds(rows, 6)).select("fold", "start", "n_test", "n_train")


@query("win_12_season_folds", "SELECT t.season AS test, count(*) FILTER (c.season < t.season) AS n_train, count(*) FILTER (c.season = t.season) AS n_test FROM contest c, (SELECT DISTINCT season FROM contest) t GROUP BY 1 HAVING count(*) FILTER (c.season < t.season) > 0")
def win_12(t):
    by = t["contest"].groupBy("season").agg(F.count("*").alias("n_test"))
    before = F.sum("n_test").over(W.orderBy("season").rowsBetween(W.unboundedPreceding, -1))
    return by.select(F.col("season").alias("test"), before.alias("n_train"), "n_test").where("n_train > 0")


@query("win_13_hold_out", "SELECT game_id FROM contest ORDER BY kickoff DESC, game_id DESC LIMIT greatest(200, CAST(floor((SELECT count(*) FROM contest) * 0.2) AS INTEGER))")
def win_13(t):
    return V.newest(t["contest"], 0.2, None, 200).select("game_id")


@query("win_14_recency", "SELECT game_id, round(power(5e-1, floor(epoch((SELECT max(kickoff) FROM contest) - kickoff)) / 86400 / 365), 6) AS weight FROM contest")
def win_14(t):
    return rounded(V.recency(t["contest"], 365).select("game_id", "weight"))


@query("win_15_weekly_cutoffs", "WITH k AS (SELECT season, off_id AS team, CAST(CASE WHEN month(kickoff) = 12 THEN 20 ELSE (dayofyear(kickoff) - 1) // 18 END AS INTEGER) AS wk, y FROM obs), w AS (SELECT season, team, wk, sum(y) AS s, count(*) AS n FROM k GROUP BY 1, 2, 3) SELECT season, team, wk, CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS n_before, coalesce(sum(s) OVER b, 0) AS s_before FROM w WINDOW b AS (PARTITION BY season, team ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_15(t):
    wk = F.when(F.month("kickoff") == 12, 20).otherwise(F.floor((F.dayofyear("kickoff") - 1) / 18)).cast("int")
    w = _sides(t).groupBy("season", "team", wk.alias("wk")).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    b = Q.history(["season", "team"], ["wk"])
    return w.select("season", "team", "wk", F.coalesce(F.sum("n").over(b), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(b), F.lit(0.0)).alias("s_before"))


# --- sorts, sets


@query("srt_1_total_order", "SELECT game_id, row_number() OVER (PARTITION BY season ORDER BY kickoff, game_id) AS k FROM contest")
def srt_1(t):
    return t["contest"].select("game_id", F.row_number().over(W.partitionBy("season").orderBy("kickoff", "game_id")).cast("long").alias("k"))


@query("set_1_home_away", "SELECT game_id, home_id AS team, 1 AS home FROM contest UNION ALL SELECT game_id, away_id, 0 FROM contest")
def set_1(t):
    c = t["contest"]
    return c.select("game_id", F.col("home_id").alias("team"), F.lit(1).alias("home")).unionByName(c.select("game_id", F.col("away_id").alias("team"), F.lit(0).alias("home")))


@query("set_2_entities", "SELECT season, home_id AS team FROM contest UNION SELECT season, away_id FROM contest")
def set_2(t):
    c = t["contest"]
    return c.select("season", F.col("home_id").alias("team")).unionByName(c.select("season", F.col("away_id").alias("team"))).distinct()


@query("set_3_intersection", "SELECT home_id AS team FROM contest WHERE season = 1996 INTERSECT SELECT away_id FROM contest WHERE season = 1997")
def set_3(t):
    c = t["contest"]
    return c.where("season = 1996").select(F.col("home_id").alias("team")).intersect(c.where("season = 1997").select("away_id"))


@query("set_4_difference", "SELECT game_id FROM contest WHERE game_id % 2 = 0 EXCEPT ALL SELECT game_id FROM contest WHERE game_id % 3 = 0")
def set_4(t):
    c = t["contest"].select("game_id")
    return c.where("game_id % 2 = 0").exceptAll(c.where("game_id % 3 = 0"))


@query("set_5_append", "SELECT game_id, home_score, NULL::INTEGER AS neutral FROM contest WHERE season < 1998 UNION ALL SELECT game_id, home_score, neutral FROM contest WHERE season >= 1998")
def set_5(t):
    c = t["contest"]
    return c.where("season < 1998").select("game_id", "home_score").unionByName(c.where("season >= 1998").select("game_id", "home_score", "neutral"), allowMissingColumns=True)


# --- table maintenance

_OLD = "SELECT game_id, home_score, collected, 'old' AS src FROM contest WHERE season < 1999"
_NEW = "SELECT game_id, home_score + 1 AS home_score, collected + INTERVAL '1' DAY AS collected, 'new' AS src FROM contest WHERE season >= 1998"


@query("ups_1_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.game_id, o.game_id) AS game_id, coalesce(n.home_score, o.home_score) AS home_score, coalesce(o.collected, n.collected) AS collected, coalesce(n.src, o.src) AS src FROM o FULL JOIN n ON o.game_id = n.game_id")
def ups_1(t):
    return U.upsert(t.sql(_OLD), t.sql(_NEW), ["game_id"], ("collected",))


@query("ups_2_insert_new", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE game_id NOT IN (SELECT game_id FROM o)")
def ups_2(t):
    return U.insert_new(t.sql(_OLD), t.sql(_NEW), ["game_id"])


@query("ups_3_insert_or_ignore", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def ups_3(t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber")
    return U.insert_new(li.where("l_linenumber < 4").dropDuplicates(), li, ["l_orderkey", "l_linenumber"])


@query("ups_4_correction", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.game_id, n.game_id) AS game_id, coalesce(n.home_score, o.home_score) AS home_score, coalesce(o.collected, n.collected) AS collected, coalesce(o.src, n.src) AS src FROM o FULL JOIN n ON o.game_id = n.game_id")
def ups_4(t):
    return U.correct(t.sql(_OLD), t.sql(_NEW), ["game_id"], ("home_score",))


_FED = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 80 ELSE 81 END AS feed FROM lineitem"


@query("ups_5_last_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, feed FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY feed, l_partkey DESC) AS k FROM ({_FED})) WHERE k = 1")
def ups_5(t):
    return U.first_of(t.sql(_FED), ["l_orderkey", "l_linenumber"], F.asc("feed"), F.desc("l_partkey"))


@query("ups_6_first_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, feed FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, feed) AS k FROM ({_FED})) WHERE k = 1")
def ups_6(t):
    return U.first_of(t.sql(_FED), ["l_orderkey", "l_linenumber"], F.asc("l_partkey"), F.asc("feed"))


@query("ups_7_append_only", "SELECT pred_id, round(p_home, 6) AS p_home FROM prediction WHERE pred_id % 97 = 0")
def ups_7(t):
    before = t["prediction"].select("pred_id", F.round("p_home", 6).alias("p_home"))
    after = before.withColumn("p_home", F.when(F.col("pred_id") % 97 == 0, -1.0).otherwise(F.col("p_home")))
    return U.lost_rows(before, after)


@query("ups_8_constraints", "SELECT pred_id, CASE WHEN created + INTERVAL '150' MINUTE > kickoff THEN 'cutoff' WHEN origin <> 'live' THEN 'origin' END AS reason FROM prediction")
def ups_8(t):
    rules = {"cutoff": F.col("created") + A.minutes(150) <= F.coalesce("kickoff", "created"), "origin": F.col("origin").isin("live")}
    return U.checked(t["prediction"], rules).select("pred_id", "reason")


@query("ups_9_separation", "SELECT game_id, neutral FROM contest")
def ups_9(t):
    return U.refuse_columns(t["contest"].select("game_id", "neutral"), ("home_score", "away_score"))


@query("ups_10_idempotent_insert", "SELECT DISTINCT g, origin FROM (SELECT CASE WHEN game_id % 9 = 0 THEN NULL ELSE game_id END AS g, origin FROM prediction)")
def ups_10(t):
    rows = t["prediction"].select(F.when(F.col("game_id") % 9 != 0, F.col("game_id")).alias("g"), "origin")
    return U.insert_new(rows.where("origin = 'live'").dropDuplicates(), rows, ["g", "origin"], null_safe=True)


@query("ups_11_invalidate", "SELECT 'note' AS kind, count(*) AS n FROM prediction WHERE pred_id % 11 = 0 UNION ALL SELECT 'evaluation', count(*) FROM graded WHERE pred_id % 11 <> 0")
def ups_11(t):
    ids = t["prediction"].where("pred_id % 11 = 0").select("pred_id")
    notes, left = U.invalidate(ids.limit(0).withColumn("reason", F.lit("")), t["graded"].select("pred_id"), ids, "bad input")
    return notes.agg(F.count("*").alias("n")).select(F.lit("note").alias("kind"), "n").unionByName(left.agg(F.count("*").alias("n")).select(F.lit("evaluation").alias("kind"), "n"))


_VERSIONS = "SELECT 'v' || (1 + r_regionkey // 3) || '.' || (r_regionkey % 3 * 5) AS version, CASE WHEN r_regionkey = 2 THEN 'champion' ELSE 'archived' END AS status, r_name AS reason FROM region"
_VERSIONS_SPARK = _VERSIONS.replace("(1 + r_regionkey // 3)", "CAST(1 + floor(r_regionkey / 3) AS STRING)").replace("(r_regionkey % 3 * 5)", "CAST(r_regionkey % 3 * 5 AS STRING)")


@query("ups_12_champion_switch", f"SELECT version, CASE WHEN version = 'v2.0' THEN 'champion' ELSE 'archived' END AS status, CASE WHEN version = 'v2.0' THEN reason || '; better' ELSE reason END AS reason FROM ({_VERSIONS})")
def ups_12(t):
    return U.switch_champion(t.sql(_VERSIONS_SPARK), "v2.0", "better")


@query("ups_13_next_version", f"WITH v AS (SELECT max(struct_pack(a := CAST(split_part(substr(version, 2), '.', 1) AS INTEGER), b := CAST(split_part(version, '.', 2) AS INTEGER))) AS m FROM ({_VERSIONS})) SELECT 'v' || m.a || '.' || (m.b + 1) AS minor, 'v' || (m.a + 1) || '.0' AS major FROM v")
def ups_13(t):
    v = t.sql(_VERSIONS_SPARK)
    return U.next_version(v, False).withColumnRenamed("version", "minor").join(F.broadcast(U.next_version(v, True).withColumnRenamed("version", "major")))


@query("ups_14_content_hash", "SELECT game_id, sha256('{\"away_score\":\"' || format('{:,.8f}', away_score) || '\",\"game_id\":' || game_id || ',\"home_score\":\"' || format('{:,.8f}', home_score) || '\"}') AS h FROM contest")
def ups_14(t):
    return t["contest"].select("game_id", U.content_hash({"game_id": "bigint", "home_score": "double", "away_score": "double"}).alias("h"))


# --- aggregates over contests


@query("agg_21_season_summary", """WITH s AS (SELECT o.*, avg(margin) OVER (PARTITION BY season, off_id) AS r FROM obs o), x AS (SELECT a.*, b.r AS opp FROM s a JOIN (SELECT DISTINCT season, off_id, r FROM s) b ON a.season = b.season AND a.def_id = b.off_id)
SELECT season, off_id AS team, count(*) AS n, round(avg(y), 6) AS ppg, round(avg(margin), 6) AS margin, round(avg(margin) FILTER (loc = 1), 6) AS home_margin, round(avg(margin) FILTER (loc = -1), 6) AS away_margin,
round(avg(opp), 6) AS sos, round(sum(margin * y) / sum(y), 6) AS weighted, string_agg(def_id, '-' ORDER BY kickoff, game_id) AS opponents FROM x GROUP BY 1, 2""")
def agg_21(t):
    from ..operators.features import season_summary

    return rounded(season_summary(t["obs"]))


#: Box lines of a side of a contest, from its order lines; the starter is whom most of its lines come from.
_BOX = """SELECT l_orderkey AS game_id, l_suppkey AS team, sum(CASE WHEN l_linenumber % 3 = 0 AND l_quantity > 25 THEN 1 ELSE 0 END) AS third_conv, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS third_att,
  sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) AS red_trips, avg(CASE WHEN l_linenumber <= 2 THEN (CASE WHEN l_discount >= 5e-2 THEN 1e0 ELSE 0e0 END) END) AS red_rate,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS turnovers, sum(CASE WHEN l_linestatus = 'F' AND l_tax < 4e-2 THEN 1 ELSE 0 END) AS fg_made, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS fg_att
  FROM lineitem GROUP BY l_orderkey, l_suppkey"""
_STARTS = """SELECT o.season, o.off_id AS team, o.game_id, o.kickoff, q.starter, q.attempts, q.gain FROM obs o JOIN (SELECT l_orderkey AS game_id, l_suppkey AS team,
  min(CASE WHEN l_quantity > 10 THEN l_partkey % 3 END) AS starter, count(*) AS attempts, sum(l_quantity) AS gain FROM lineitem GROUP BY l_orderkey, l_suppkey) q ON q.game_id = o.game_id AND q.team = o.off_id"""


@query("agg_21_season_report", f"""WITH bx AS ({_BOX}), st AS (SELECT * FROM ({_STARTS}) WHERE starter IS NOT NULL), rt AS (SELECT season, off_id AS team, avg(margin) AS r FROM obs GROUP BY 1, 2),
o AS (SELECT season, off_id AS team, def_id AS other, kickoff, game_id, loc, y, margin, row_number() OVER (PARTITION BY season, off_id ORDER BY kickoff DESC, game_id DESC) AS back FROM obs),
a AS (SELECT o.season, o.team, count(*) AS games, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses, avg(y) AS ppg, avg(y - margin) AS opp_ppg, avg(margin) AS avg_margin, avg(margin) FILTER (loc = 1) AS home_margin,
  count(*) FILTER (loc = 1) AS n_home, avg(margin) FILTER (loc = -1) AS away_margin, count(*) FILTER (loc = -1) AS n_away, string_agg(CAST(CAST(floor(margin) AS BIGINT) AS VARCHAR), ',' ORDER BY back) FILTER (back <= 3) AS last3,
  string_agg(CAST(CAST(floor(margin) AS BIGINT) AS VARCHAR), ',' ORDER BY back) FILTER (back <= 5) AS last5, avg(rt.r) AS sos FROM o LEFT JOIN rt ON rt.season = o.season AND rt.team = o.other GROUP BY 1, 2),
b AS (SELECT o.season, o.team, sum(m.third_conv) / nullif(sum(m.third_att), 0) AS third_down, sum(m.red_rate * m.red_trips) / nullif(sum(m.red_trips) FILTER (m.red_rate IS NOT NULL), 0) AS red_zone, avg(m.turnovers) AS turnovers_pg,
  avg(v.turnovers) AS takeaways_pg, avg(v.turnovers) - avg(m.turnovers) AS turnover_margin, sum(m.fg_made) AS fg_made, sum(m.fg_att) AS fg_att
  FROM o LEFT JOIN bx m ON m.game_id = o.game_id AND m.team = o.team LEFT JOIN bx v ON v.game_id = o.game_id AND v.team = o.other GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN starter IS DISTINCT FROM lag(starter) OVER w THEN 1 ELSE 0 END AS fresh, lag(starter) OVER w AS before FROM st WINDOW w AS (PARTITION BY season, team ORDER BY kickoff, game_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY season, team ORDER BY kickoff, game_id) AS island FROM f), h AS (SELECT season, team, island, any_value(starter) AS s, count(*) AS n FROM g GROUP BY 1, 2, 3),
c AS (SELECT season, team, string_agg(CAST(s AS VARCHAR) || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ' > ' ORDER BY island) AS starter_sequence FROM h GROUP BY 1, 2),
l AS (SELECT season, team, arg_max(starter, (kickoff, game_id)) AS last_starter, arg_max(CASE WHEN before IS NOT NULL AND before <> starter THEN 1 ELSE 0 END, (kickoff, game_id)) AS starter_changed FROM f GROUP BY 1, 2),
d AS (SELECT season, team, count(*) FILTER (starter = last_starter) AS starts, sum(attempts) FILTER (starter = last_starter) AS starter_attempts, sum(gain) FILTER (starter = last_starter) / sum(attempts) FILTER (starter = last_starter) AS starter_gain,
  sum(attempts) FILTER (starter = last_starter) / sum(attempts) AS starter_share FROM st JOIN l USING (season, team) GROUP BY 1, 2)
SELECT season, team, games, wins, losses, round(ppg, 6) AS ppg, round(opp_ppg, 6) AS opp_ppg, round(avg_margin, 6) AS avg_margin, round(home_margin, 6) AS home_margin, n_home, round(away_margin, 6) AS away_margin, n_away, last3, last5, round(sos, 6) AS sos,
  round(third_down, 6) AS third_down, round(red_zone, 6) AS red_zone, round(turnovers_pg, 6) AS turnovers_pg, round(takeaways_pg, 6) AS takeaways_pg, round(turnover_margin, 6) AS turnover_margin, CAST(fg_made AS BIGINT) AS fg_made, CAST(fg_att AS BIGINT) AS fg_att,
  starter_sequence, last_starter, starter_changed, starts, CAST(starter_attempts AS BIGINT) AS starter_attempts, round(starter_gain, 6) AS starter_gain, round(starter_share, 6) AS starter_share
FROM a JOIN b USING (season, team) LEFT JOIN c USING (season, team) LEFT JOIN l USING (season, team) LEFT JOIN d USING (season, team)""")
def agg_21_report(t):
    from ..operators.features import season_report

    rated = t["obs"].groupBy("season", F.col("off_id").alias("team")).agg(F.avg("margin").alias("r"))
    return rounded(season_report(t["obs"], t.sql(_BOX), t.sql(_STARTS), rated))


@query("agg_22_crosstab", "SELECT season, count(*) FILTER (neutral = 0) AS home, count(*) FILTER (neutral = 1) AS neutral FROM contest GROUP BY 1")
def agg_22(t):
    return t["contest"].groupBy("season").pivot("neutral", [0, 1]).count().fillna(0).toDF("season", "home", "neutral")


@query("agg_23_metric_pivot", "WITH l AS (SELECT off_id AS team, 'y' AS metric, avg(y) AS v FROM obs GROUP BY 1 UNION ALL SELECT off_id, 'margin', avg(margin) FROM obs GROUP BY 1) SELECT team, round(max(v) FILTER (metric = 'y'), 6) AS y, round(max(v) FILTER (metric = 'margin'), 6) AS margin FROM l GROUP BY 1")
def agg_23(t):
    long = t["obs"].groupBy(F.col("off_id").alias("team")).agg(F.avg("y").alias("y"), F.avg("margin").alias("margin")).unpivot("team", ["y", "margin"], "metric", "v")
    return rounded(long.groupBy("team").pivot("metric", ["y", "margin"]).agg(F.first("v")))


@query("agg_24_division_shrink", """WITH r AS (SELECT off_id AS team, off_id % 3 AS division, avg(margin) AS r FROM obs WHERE season = 1996 GROUP BY 1, 2), m AS (SELECT division, avg(r) AS m FROM r GROUP BY 1),
e AS (SELECT DISTINCT off_id AS team, off_id % 3 AS division FROM obs) SELECT e.team, round(CASE WHEN r.r IS NULL THEN m.m ELSE 0.6 * r.r + 0.4 * m.m END, 6) AS prior FROM e LEFT JOIN r ON e.team = r.team LEFT JOIN m ON m.division = e.division""")
def agg_24(t):
    from ..operators.ratings import shrunk_priors

    o = t["obs"].select("season", F.col("off_id").alias("team"), (F.col("off_id") % 3).alias("division"), "margin")
    return rounded(shrunk_priors(o.where("season = 1996").groupBy("team").agg(F.avg("margin").alias("r")), o.select("team", "division").distinct(), 0.6))


@query("agg_25_matchup_spread", "WITH r AS (SELECT off_id, avg(y) AS o FROM obs GROUP BY 1), d AS (SELECT def_id, avg(y) AS d FROM obs GROUP BY 1) SELECT round(sqrt(2 * (var_pop(o) + var_pop(d))), 6) AS spread FROM r JOIN d ON r.off_id = d.def_id")
def agg_25(t):
    r, d = t["obs"].groupBy(F.col("off_id").alias("team")).agg(F.avg("y").alias("o")), t["obs"].groupBy(F.col("def_id").alias("team")).agg(F.avg("y").alias("d"))
    return rounded(r.join(d, "team").agg(F.sqrt(2 * (F.var_pop("o") + F.var_pop("d"))).alias("spread")))


@query("agg_26_popularity", "SELECT team, count(*) AS n FROM (SELECT home_id AS team FROM contest WHERE feed_group = 80 UNION ALL SELECT away_id FROM contest WHERE feed_group = 80) GROUP BY 1")
def agg_26(t):
    c = t["contest"].where("feed_group = 80")
    return c.select(F.explode(F.array("home_id", "away_id")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))
