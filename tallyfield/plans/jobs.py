"""Queries on landed documents, streams and domains. Documents are built from the given tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import availability as A
from ..operators import grading as G
from ..operators import ratings as R
from ..sources import documents as D
from ..sources.shared import checkpointed, fresh
from ..streaming import jobs as J
from .domain import domain
from .grading import rounded
from .ratings import _pooled
from .registry import query

STRING = "string"


def _landed(df, t, name):
    """JSON text written to a landing folder."""
    path = fresh(t.spark, name)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("compression", "gzip").text(path)
    return path


def _scoreboards(t):
    """One document per season and feed; every ninth event lacks its away side, every seventh isn't finished."""
    c = t["contest"]
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.col(f"{s}_score").cast(STRING).alias("score"), F.struct(F.col(f"{s}_id").cast(STRING).alias("id"), F.when(F.col(f"{s}_id") % 2 == 0, F.concat(F.lit("Supplier "), F.col(f"{s}_id").cast(STRING))).alias("name"), F.lit(None).cast(STRING).alias("shortName"), F.concat(F.lit("S"), F.col(f"{s}_id").cast(STRING)).alias("abbreviation")).alias("team"))
    both = F.when(F.col("game_id") % 9 == 0, F.array(side("home"))).otherwise(F.array(side("away"), side("home")))
    status = F.struct(F.when(F.col("game_id") % 7 == 0, "in").otherwise("post").alias("state"), (F.col("game_id") % 7 != 0).alias("completed"))
    event = F.struct(F.col("game_id").cast(STRING).alias("id"), F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(F.col("season").alias("year")).alias("season"), F.struct(F.lit(1).alias("number")).alias("week"), status.alias("status"), F.array(F.struct((F.col("neutral") == 1).alias("neutral"), both.alias("competitors"))).alias("competitions"))
    docs = c.groupBy("season", F.month("kickoff").alias("m")).agg(F.collect_list(event).alias("events")).select("events")
    return D.read_documents(t.spark, _landed(docs, t, "scoreboards"), D.SCOREBOARD)


@query("src_1_scoreboards", """WITH g AS (SELECT * FROM contest WHERE game_id % 9 <> 0) SELECT CAST(g.game_id AS VARCHAR) AS game_id, season, CAST(home_id AS VARCHAR) AS home_id, CAST(away_id AS VARCHAR) AS away_id, neutral,
CASE WHEN game_id % 7 <> 0 THEN home_score END AS home_score, CASE WHEN game_id % 7 <> 0 THEN away_score END AS away_score, CASE WHEN home_id % 2 = 0 THEN 'Supplier ' || home_id ELSE 'S' || home_id END AS home_name FROM g""")
def src_1(t):
    games, results, teams = D.scoreboard(checkpointed(_scoreboards(t)))
    name = teams.select(F.col("team_id").alias("home_id"), F.col("name").alias("home_name"))
    return games.join(results, "game_id", "left").join(name, "home_id").select("game_id", "season", "home_id", "away_id", "neutral", "home_score", "away_score", "home_name")


def _summaries(t):
    """One document per user of ``events``: drives of ten plays, a box with statistics and athletes, sides and context."""
    p = t["play"].withColumn("d", F.floor((F.col("seq") - 1) / 10).cast("int"))
    s = lambda c: F.col(c).cast("int")
    play = F.struct("seq", F.struct(F.col("type"), s("period").alias("period"), F.when(F.col("seq") % 4 != 0, F.col("off_side")).alias("team"), s("down").alias("down"), s("dist").alias("distance"), s("yds").alias("yards"), F.lit(0).alias("homeScore"), F.lit(0).alias("awayScore")).alias("p"))
    drives = p.groupBy("event_key", "d").agg(F.transform(F.array_sort(F.collect_list(play)), lambda x: x["p"]).alias("plays"), F.min_by("off_side", "seq").alias("team"))
    drives = drives.groupBy("event_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.struct("team", "plays").alias("x")))), lambda x: x["x"]).alias("drives"))
    who = p.groupBy("event_key", "off_side", "type").agg(F.count("*").alias("n"), F.sum("yds").alias("y")).groupBy("event_key", "off_side").agg(F.array_sort(F.collect_list(F.struct(F.col("type").alias("id"), F.array(F.concat(F.col("y").cast(STRING), F.lit("/"), F.col("n").cast(STRING)), F.col("n").cast(STRING)).alias("stats")))).alias("athletes"), F.sum("n").alias("n"))
    box = F.struct(F.col("off_side").alias("team"), F.array(F.struct(F.lit("plays").alias("name"), F.col("n").cast(STRING).alias("displayValue"))).alias("statistics"), F.array(F.struct(F.lit("passing").alias("name"), F.array(F.lit("C/ATT"), F.lit("SACKS")).alias("labels"), F.col("athletes"))).alias("players"))
    boxes = who.groupBy("event_key").agg(F.array_sort(F.collect_list(box)).alias("box"))
    out = drives.join(boxes, "event_key")
    k = F.col("event_key")
    sides = F.array(*(F.struct(F.lit(x).alias("team"), F.lit(h).alias("homeAway"), (k * m % 50).cast(STRING).alias("score")) for x, h, m in (("A", "home", 7), ("B", "away", 11))))
    context = F.struct((k % 40).cast("double").alias("temperature"), F.concat(F.lit("venue "), k.cast(STRING)).alias("venue"), (k % 7).cast("double").alias("line"), F.array(F.struct(F.lit("home").alias("type"), F.lit("1-0").alias("summary")), F.struct(F.lit("total").alias("type"), F.concat(k.cast(STRING), F.lit("-1")).alias("summary"))).alias("records"), F.array(F.struct(F.array(F.lit("X"), F.lit("Y")).alias("names")), F.struct(F.array(F.lit("Z")).alias("names"))).alias("broadcasts"), F.array(F.struct(F.lit("H -3").alias("details"))).alias("odds"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(i.cast(STRING).alias("athlete"), F.when(i == 0, "Out").otherwise("Doubtful").alias("status"))).alias("injuries"))
    docs = out.select(k.cast(STRING).alias("id"), F.when(k % 5 == 0, "in").otherwise("post").alias("state"), (k % 5 != 0).alias("completed"), "drives", "box", sides.alias("sides"), context.alias("context"))
    return D.read_documents(t.spark, _landed(docs, t, "summaries"), D.SUMMARY)


@query("src_2_summary_plays", "WITH p AS (SELECT *, (seq - 1) // 10 AS d FROM play) SELECT CAST(event_key AS VARCHAR) AS event_id, CAST(d AS INTEGER) AS drive, CAST((seq - 1) % 10 AS INTEGER) AS place, CASE WHEN seq % 4 <> 0 THEN off_side ELSE first_value(off_side) OVER (PARTITION BY event_key, d ORDER BY seq) END AS off, type FROM p")
def src_2(t):
    return D.summary_plays(_summaries(t)).select("event_id", "drive", "place", "off", "type")


@query("src_3_box_columns", "SELECT CAST(event_key AS VARCHAR) AS event_id, off_side AS team, CAST(count(*) AS VARCHAR) AS plays FROM play GROUP BY event_key, off_side")
def src_3(t):
    return D.box_columns(_summaries(t), ["plays"])


@query("src_4_athlete_totals", 'SELECT CAST(event_key AS VARCHAR) AS event_id, off_side AS team, CAST(count(*) AS DOUBLE) AS "SACKS" FROM play GROUP BY event_key, off_side')
def src_4(t):
    return D.athlete_totals(_summaries(t), ["SACKS"])


@query("src_5_starters", "WITH a AS (SELECT event_key, off_side, type, count(*) AS n FROM play GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY event_key, off_side ORDER BY n DESC, type) AS k FROM a) SELECT CAST(event_key AS VARCHAR) AS event_id, off_side AS team, type AS qb_id, CAST(n AS DOUBLE) AS att FROM r WHERE k = 1")
def src_5_starters(t):
    return D.starters(_summaries(t)).select("event_id", "team", "qb_id", "att")


@query("src_6_lenient_numbers", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) WHEN 1 THEN value END AS n FROM events")
def src_6(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"displayValue": "'), F.get_json_object("props", "$.k"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.col("value").cast(STRING)).otherwise("none")
    return t["events"].select("event_id", S.lenient_number(text).alias("n"))


@query("src_7_contest_csv", "SELECT CAST(game_id AS VARCHAR) AS game_id, home_score, away_score FROM contest WHERE game_id % 7 <> 0 AND kickoff < TIMESTAMP '1999-01-01'")
def src_7(t):
    path = fresh(t.spark, "csv")
    t["contest"].select("game_id", "kickoff", "home_score", F.when(F.col("game_id") % 7 != 0, F.col("away_score")).alias("away_score"), F.lit(True).alias("completed")).write.option("compression", "gzip").csv(path, header=True)
    schema = "game_id STRING, kickoff TIMESTAMP_NTZ, home_score DOUBLE, away_score DOUBLE, completed BOOLEAN"
    return D.read_contests(t.spark, path, schema, F.lit("1999-01-01").cast("timestamp_ntz")).select("game_id", "home_score", "away_score")


@query("src_8_gzip_documents", "SELECT CAST(event_key AS VARCHAR) AS event_id, count(*) AS plays, count(DISTINCT off_side) AS teams FROM play GROUP BY 1")
def src_8(t):
    d = checkpointed(_summaries(t))
    return D.summary_plays(d).groupBy("event_id").agg(F.count("*").alias("plays")).join(D.box_columns(d, ["plays"]).groupBy("event_id").agg(F.count("*").alias("teams")), "event_id")


@query("src_9_season_cache", "SELECT season, count(*) AS n, CAST(sum(CASE WHEN season = 2000 THEN home_score + 1 ELSE home_score END) AS DOUBLE) AS s FROM contest GROUP BY 1")
def src_9(t):
    path = fresh(t.spark, "seasons")
    c = t["contest"].select("game_id", "home_score", "season")
    D.write_season(c, path)
    D.write_season(c.where("season = 2000").withColumn("home_score", F.col("home_score") + 1), path)
    return t.spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n"), F.sum("home_score").alias("s"))


@query("src_10_deliverables", "SELECT pred_id, round(p_home, 5) AS p_home FROM prediction")
def src_10(t):
    path = fresh(t.spark, "deliverable")
    D.write_deliverable(t["prediction"].select("pred_id", "p_home"), path)
    return t.spark.read.schema("pred_id LONG, p_home DOUBLE").csv(path, header=True)


@query("src_11_missing_facts", "SELECT game_id FROM contest WHERE game_id % 4 <> 0 AND season = 1997")
def src_11(t):
    c = t["contest"].select("game_id", "season")
    return D.missing_facts(c, c.where("game_id % 4 = 0"), only=c.where("season = 1997")).select("game_id")


@query("src_12_import_frozen", "SELECT game_id, 'v0' AS model_version FROM prediction WHERE model_version = 'v1.0' AND game_id % 3 <> 0 AND game_id % 5 <> 0")
def src_12(t):
    p = t["prediction"].where("model_version = 'v1.0'")
    features = t["contest"].where("game_id % 5 <> 0").select("game_id", "neutral")
    return D.import_frozen(p.select("game_id", "p_home"), features, p.where("game_id % 3 = 0"), "v0").select("game_id", "model_version")


@query("src_13_table_read", "SELECT pred_id FROM prediction WHERE model_version = 'v1.1' ORDER BY created, pred_id")
def src_13(t):
    return t["prediction"].where("model_version = 'v1.1'").orderBy("created", "pred_id").select("pred_id")


@query("src_15_stored_grid")
def src_15(t):
    """The grid is fitted once on the earlier half and read where it exists."""
    from ..operators.plays import expected_points
    from .plays import _scored

    path = fresh(t.spark, "grid")
    for _ in range(2):
        try:
            return rounded(t.spark.read.schema("b_down INT, b_field INT, b_dist INT, ep DOUBLE").parquet(f"{path}/ep1"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            expected_points(_scored(t).where("period <= 2")).write.parquet(f"{path}/ep1")


@query("src_16_slate_rows", "SELECT DISTINCT CAST(event_key AS VARCHAR) AS game_id, 'venue ' || event_key AS venue, CAST(event_key AS VARCHAR) || '-1' AS record, 'H -3' AS line, 'X/Y/Z' AS broadcast FROM play")
def src_16(t):
    return D.slate_rows(_summaries(t)).drop("temperature")


@query("src_17_summary_results", "SELECT DISTINCT CAST(event_key AS VARCHAR) AS game_id, CAST(event_key * 7 % 50 AS DOUBLE) AS home_score, CAST(event_key * 11 % 50 AS DOUBLE) AS away_score FROM play WHERE event_key % 5 <> 0")
def src_17(t):
    return D.summary_results(_summaries(t))


@query("src_18_context", "SELECT DISTINCT CAST(event_key AS VARCHAR) AS game_id, 'venue ' || event_key AS venue, CAST(event_key % 7 AS DOUBLE) AS line, 1 AS out, CAST(event_key % 3 AS INTEGER) AS doubtful FROM play")
def src_18(t):
    return D.pre_event_context(_summaries(t)).select("game_id", "venue", "line", "out", "doubtful")


# --- streams

_ARRIVALS = "SELECT game_id, home_score, collected, season FROM contest UNION ALL SELECT game_id, home_score + 3, collected + INTERVAL '2' DAY, season + 1 FROM contest WHERE game_id % 4 = 0"


def _arrivals(t, files=1):
    rows = checkpointed(t.sql(_ARRIVALS))
    return J.landed(t.spark, J.land_in_parts(rows, "season", "landing"), rows.schema, files)


@query("str_1_update_cycle", f"SELECT game_id, home_score FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY season DESC, collected DESC) AS k FROM ({_ARRIVALS})) WHERE k = 1")
def str_1(t):
    return J.keep_latest(_arrivals(t), ["game_id"], ["season", "collected"], (), fresh(t.spark, "cycle"), fresh(t.spark, "state")).select("game_id", "home_score")


@query("str_2_collect_outcomes", "SELECT a.event_id AS asked, b.event_id AS outcome FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '6' HOUR")
def str_2(t):
    path = fresh(t.spark, "events")
    t["events"].write.parquet(path)  # a stream reads a folder
    e = J.landed(t.spark, path, t["events"].schema)
    side = lambda kind, s: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{s}_id"), F.col("user_id").alias(f"{s}_user"), F.col("ts").cast("timestamp").alias(f"{s}_ts"))
    joined = J.matched(side("click", "l"), side("purchase", "r"), "user", "l_ts", "r_ts", "6 HOURS")
    return J.run(joined.select(F.col("l_id").alias("asked"), F.col("r_id").alias("outcome")), fresh(t.spark, "outcomes"), fresh(t.spark, "state"))


_RESULTS = "SELECT game_id, avail, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win FROM contest_avail WHERE feed_group = 80"


@query("str_2_pending_outcomes", f"SELECT pred_id, game_id, CASE WHEN home_win IS NULL THEN 'pending' ELSE 'done' END AS status, home_win FROM prediction LEFT JOIN ({_RESULTS}) USING (game_id)")
def str_2_pending(t):
    """Logged predictions that should be over, with their outcomes as these land; of contests whose results never come the predictions stay pending."""
    zone = lambda c: F.col(c).cast("timestamp").alias(c)
    asked = checkpointed(t["prediction"].select("pred_id", F.col("game_id").alias("l_game"), zone("kickoff")))
    found = checkpointed(t.sql(_RESULTS).select(F.col("game_id").alias("r_game"), zone("avail"), "home_win"))
    streams = []
    for rows, at, key, none in ((asked, "kickoff", "l_game", -1), (found, "avail", "r_game", -2)):
        clock = asked.agg((F.max("kickoff") + A.minutes(7 * 1440)).alias(at), F.lit(none).cast("long").alias(key))  # after the last contest time goes on
        landing = J.land_in_parts(rows.unionByName(clock, allowMissingColumns=True).withColumn("part", F.year(at)), "part", "landing")
        streams.append(J.landed(t.spark, landing, rows.schema, 1))
    joined = J.matched(*streams, "game", "kickoff", "avail", "1 DAY", "2 days", how="left")
    out = joined.select("pred_id", F.col("l_game").alias("game_id"), F.when(F.col("home_win").isNull(), "pending").otherwise("done").alias("status"), "home_win")
    return J.run(out, fresh(t.spark, "outcomes"), fresh(t.spark, "state")).where("pred_id IS NOT NULL")


@query("str_3_late_facts", "SELECT count(*) AS facts, count(*) FILTER (collected < kickoff + INTERVAL '270' MINUTE AND collected > kickoff) AS early FROM contest")
def str_3(t):
    """Facts that land late carry their availability; nothing is dropped."""
    rows = checkpointed(t["contest"].select("game_id", "kickoff", "collected", F.quarter("collected").alias("q")))
    stream = J.landed(t.spark, J.land_in_parts(rows, "q", "late"), rows.schema, 1)
    a = J.run(A.with_availability(stream, 270), fresh(t.spark, "facts"), fresh(t.spark, "state"))
    return a.agg(F.count("*").alias("facts"), F.count_if(F.col("avail") == F.col("collected")).alias("early"))


@query("str_4_corrections", f"SELECT game_id, arg_max(home_score, season) AS home_score, min(collected) AS collected FROM ({_ARRIVALS}) GROUP BY 1")
def str_4(t):
    return J.keep_corrections(_arrivals(t), ["game_id"], ("home_score", "season"), ["season", "collected"], fresh(t.spark, "cycle"), fresh(t.spark, "state")).select("game_id", "home_score", "collected")


@query("str_5_rating_state")
def str_5(t):
    c = _pooled(t).select("pool", "game_id", "season", "kickoff", "avail", "home_id", "away_id", (F.col("home_score") - F.col("away_score")).alias("m"), "neutral", "home_division", "away_division").withColumn("part", F.year("avail"))  # written as it lands, read by nothing else
    stream = J.landed(t.spark, J.land_in_parts(c, "part", "contests"), c.schema, 1)
    return rounded(J.run(J.elo_stream(stream, 36.0, 45.0, 0.25), fresh(t.spark, "elo"), fresh(t.spark, "state")))


@query("str_6_duplicate_documents", "SELECT DISTINCT game_id FROM contest")
def str_6(t):
    rows = checkpointed(t["contest"].select("game_id", F.col("kickoff").cast("timestamp").alias("at"), F.explode(F.array(F.lit(80), F.lit(81))).alias("feed")))
    stream = J.landed(t.spark, J.land_in_parts(rows, "feed", "feeds"), rows.schema)
    return J.run(J.without_repeats(stream, ["game_id"], "at", "4000 days").select("game_id"), fresh(t.spark, "once"), fresh(t.spark, "state"))


@query("str_7_restart", "SELECT season, count(*) AS n FROM contest GROUP BY 1")
def str_7(t):
    """The job stops after the first seasons and goes on from its checkpoint when more has landed: each row is read once."""
    rows = checkpointed(t["contest"].select("game_id", "season"))
    landing, out, state = fresh(t.spark, "landing"), fresh(t.spark, "out"), fresh(t.spark, "state")
    for part in (rows.where("season < 1998"), rows.where("season >= 1998"), rows.limit(0)):
        part.write.mode("append").parquet(landing)
        done = J.run(J.landed(t.spark, landing, rows.schema, 1), out, state)
    return done.groupBy("season").agg(F.count("*").alias("n"))


# --- extension points


@query("udf_1_feature_builder", "SELECT game_id, CASE WHEN collected > kickoff AND collected < kickoff + INTERVAL '240' MINUTE THEN collected ELSE kickoff + INTERVAL '240' MINUTE END AS avail FROM contest")
def udf_1(t):
    return A.with_availability(t["contest"], domain("suppliers_short").duration_minutes).select("game_id", "avail")


@query("udf_2_domain_metrics", "SELECT 'price_pp' AS metric, count(price_pp) AS n FROM entity_stats UNION ALL SELECT 'disc_rate', count(disc_rate) FROM entity_stats UNION ALL SELECT 'return_rate', count(return_rate) FROM entity_stats UNION ALL SELECT 'tax_f', count(tax_f) FROM entity_stats")
def udf_2(t):
    return t["entity_stats"].unpivot([], list(domain("suppliers").metrics), "metric", "v").groupBy("metric").agg(F.count("v").alias("n"))


@query("udf_3_domain_subgroups", "SELECT 'neutral' AS subgroup, count(*) AS n FROM graded WHERE neutral = 1 UNION ALL SELECT 'conference', count(*) FROM graded WHERE conf_game = 1")
def udf_3(t):
    return G.melt_groups(t["graded"], domain("suppliers").subgroups()).groupBy("subgroup").agg(F.count("*").alias("n")).where(F.col("subgroup").isin("neutral", "conference"))


@query("udf_5_grouped_fold")
def udf_5(t):
    k, home, revert = domain("suppliers_short").elo
    grid = t.spark.createDataFrame([(k, home, revert)], "k double, home double, revert double")
    return rounded(R.elo(_pooled(t), grid).groupBy("pool").agg(F.count("*").alias("n"), F.max("elo_home").alias("best")), 4)


@query("udf_6_policy", "SELECT model_version, count(*) AS n FROM prediction WHERE greatest(p_home, 1 - p_home) >= 0.9 GROUP BY 1")
def udf_6(t):
    policy = domain("suppliers").policy.for_domain(high_conf=0.9)
    return t["prediction"].where(S.pick_probability(F.col("p_home")) >= policy.high_conf).groupBy("model_version").agg(F.count("*").alias("n"))
