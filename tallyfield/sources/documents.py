"""Landed documents to relations: nested JSON, CSV, trees of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lenient_number

#: Scoreboard documents: events, their competitions, and their sides.
SCOREBOARD = """events ARRAY<STRUCT<id: STRING, date: STRING, season: STRUCT<year: INT>, week: STRUCT<number: INT>,
  status: STRUCT<state: STRING, completed: BOOLEAN>, competitions: ARRAY<STRUCT<neutral: BOOLEAN, competitors: ARRAY<STRUCT<homeAway: STRING, score: STRING,
  team: STRUCT<id: STRING, name: STRING, shortName: STRING, abbreviation: STRING>>>>>>>"""
#: Summaries: drives with their plays, and the box.
SUMMARY = """id STRING, state STRING, completed BOOLEAN, drives ARRAY<STRUCT<team: STRING, plays: ARRAY<STRUCT<type: STRING, period: INT, team: STRING, down: INT, distance: INT, yards: INT, homeScore: INT, awayScore: INT>>>>,
  box ARRAY<STRUCT<team: STRING, statistics: ARRAY<STRUCT<name: STRING, displayValue: STRING>>, players: ARRAY<STRUCT<name: STRING, labels: ARRAY<STRING>, athletes: ARRAY<STRUCT<id: STRING, stats: ARRAY<STRING>>>>>>>,
  sides ARRAY<STRUCT<team: STRING, homeAway: STRING, score: STRING>>,
  context STRUCT<temperature: DOUBLE, venue: STRING, line: DOUBLE, records: ARRAY<STRUCT<type: STRING, summary: STRING>>, broadcasts: ARRAY<STRUCT<names: ARRAY<STRING>>>, odds: ARRAY<STRUCT<details: STRING>>, injuries: ARRAY<STRUCT<athlete: STRING, status: STRING>>>"""


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one a line or file; gzip is read as it is."""
    return spark.read.schema(schema).json(path)


def read_contests(spark: SparkSession, path: str, schema: str, cutoff: Column | None = None) -> DataFrame:
    """A flat CSV with typed ids; only what is completed, scored and known by ``cutoff``."""
    rows = spark.read.schema(schema).csv(path, header=True).where("completed AND home_score IS NOT NULL AND away_score IS NOT NULL")
    return rows if cutoff is None else rows.where(F.col("kickoff") < cutoff)


def scoreboard(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schedule, results, entities) of scoreboard documents. Events without a competition or without one of the sides are left out;
    a result needs a finished, completed event and two numeric scores."""
    e = docs.select(F.explode("events").alias("e")).select("e.*").withColumn("c", F.get("competitions", F.lit(0)))
    side = lambda s: F.get(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(0))
    e = e.withColumn("h", side("home")).withColumn("a", side("away")).where("c IS NOT NULL AND h IS NOT NULL AND a IS NOT NULL")
    name = lambda x: F.coalesce(f"{x}.team.name", f"{x}.team.shortName", f"{x}.team.abbreviation", F.concat(F.lit("team "), F.col(f"{x}.team.id")))
    at = F.col("date").try_cast("timestamp").alias("kickoff")
    games = e.select(F.col("id").alias("game_id"), F.col("season.year").alias("season"), F.col("week.number").alias("week"), at, F.col("h.team.id").alias("home_id"), F.col("a.team.id").alias("away_id"), F.coalesce(F.col("c.neutral"), F.lit(False)).cast("int").alias("neutral"))
    points = {s: lenient_number(F.col(f"{s}.score")) for s in "ha"}
    results = e.where((F.col("status.state") == "post") & F.col("status.completed")).select(F.col("id").alias("game_id"), points["h"].alias("home_score"), points["a"].alias("away_score")).where("home_score IS NOT NULL AND away_score IS NOT NULL")
    teams = e.select(F.explode(F.array(*(F.struct(F.col(f"{x}.team.id").alias("team_id"), name(x).alias("name")) for x in "ha"))).alias("t")).select("t.*").dropDuplicates(["team_id"])
    return games, results, teams


def summary_plays(docs: DataFrame) -> DataFrame:
    """Plays in order; a play without a side of its own has its drive's."""
    d = docs.select("id", F.posexplode("drives").alias("drive", "d"))
    p = d.select("id", "drive", F.col("d.team").alias("drive_off"), F.posexplode("d.plays").alias("place", "p"))
    return p.select(F.col("id").alias("event_id"), "drive", "place", "drive_off", F.coalesce("p.team", "drive_off").alias("off"), "p.type", "p.period", "p.down", "p.distance", "p.yards", F.col("p.homeScore").alias("hs"), F.col("p.awayScore").alias("as"))


def box_columns(docs: DataFrame, names: list[str]) -> DataFrame:
    """One row per side: statistics by name as columns."""
    b = docs.select(F.col("id").alias("event_id"), F.explode("box").alias("b"))
    m = F.map_from_entries(F.transform("b.statistics", lambda s: F.struct(s["name"], s["displayValue"])))
    return b.select("event_id", F.col("b.team").alias("team"), m.alias("m")).select("event_id", "team", *(F.try_element_at("m", F.lit(n)).alias(n) for n in names))


def athlete_totals(docs: DataFrame, labels: list[str]) -> DataFrame:
    """Sums over a side's athletes of the statistics under ``labels``; what isn't a number counts nothing."""
    b = docs.select(F.col("id").alias("event_id"), F.explode("box").alias("b")).select("event_id", "b.team", F.explode("b.players").alias("g"))
    a = b.select("event_id", "team", F.col("g.labels").alias("labels"), F.explode("g.athletes").alias("a"))
    cell = a.select("event_id", "team", F.explode(F.arrays_zip("labels", F.col("a.stats").alias("stats"))).alias("z"))
    return cell.where(F.col("z.labels").isin(*labels)).groupBy("event_id", "team").pivot("z.labels", labels).agg(F.sum(F.col("z.stats").try_cast("double")))


def starters(docs: DataFrame, group: str = "passing", label: str = "C/ATT") -> DataFrame:
    """The athlete of each side with the most attempts, read from "made/attempts"; the first listed of equals."""
    from ..functions.scalars import fraction_part
    from ..operators.plays import most_attempts

    b = docs.select(F.col("id").alias("event_id"), F.explode("box").alias("b")).select("event_id", "b.team", F.explode("b.players").alias("g")).where(F.col("g.name") == group)
    a = b.select("event_id", "team", F.col("g.labels").alias("labels"), F.posexplode("g.athletes").alias("place", "a"))
    text = F.get(F.col("a.stats"), F.array_position("labels", label).cast("int") - 1)
    return most_attempts(a.select("event_id", "team", "place", F.col("a.id").alias("qb_id"), fraction_part(text, 0).alias("cmp"), fraction_part(text, 1).alias("att")), ["event_id", "team"]).drop("place")


def summary_results(docs: DataFrame) -> DataFrame:
    """Results of completed summaries with two numeric scores."""
    score = lambda s: lenient_number(F.get(F.filter("sides", lambda x: x["homeAway"] == s), F.lit(0))["score"])
    done = docs.where((F.col("state") == "post") & F.col("completed"))
    return done.select(F.col("id").alias("game_id"), score("home").alias("home_score"), score("away").alias("away_score")).where("home_score IS NOT NULL AND away_score IS NOT NULL")


def slate_rows(docs: DataFrame) -> DataFrame:
    """Wide rows of a slate: the overall record, the first line offered, all broadcasts."""
    c = F.col("context")
    record = F.get(F.filter("context.records", lambda r: r["type"] == "total"), F.lit(0))["summary"]
    return docs.where(c.isNotNull()).select(F.col("id").alias("game_id"), c["venue"].alias("venue"), c["temperature"].alias("temperature"), record.alias("record"), F.get(c["odds"], F.lit(0))["details"].alias("line"), F.array_join(F.flatten(F.transform("context.broadcasts", lambda b: b["names"])), "/").alias("broadcast"))


def pre_event_context(docs: DataFrame) -> DataFrame:
    """What is known before an event, with counts of injuries by status."""
    count = lambda s: F.size(F.filter("context.injuries", lambda i: F.lower(i["status"]) == s))
    return docs.where("context IS NOT NULL").select(F.col("id").alias("game_id"), "context.venue", "context.temperature", F.col("context.line").alias("line"), *(F.greatest(count(s), F.lit(0)).alias(s) for s in ("out", "doubtful", "questionable")))


def missing_facts(completed: DataFrame, facts: DataFrame, key: str = "game_id", only: DataFrame | None = None) -> DataFrame:
    """Completed contests without facts, of ``only`` if given: what an incremental ingest has to read."""
    out = completed.join(facts.select(key).distinct(), key, "left_anti")
    return out if only is None else out.join(only.select(key).distinct(), key, "left_semi")


def import_frozen(frozen: DataFrame, features: DataFrame, known: DataFrame, version: str, key: str = "game_id") -> DataFrame:
    """Frozen predictions with their features, without those already logged or without features; each with a content hash."""
    from ..operators.tables import content_hash

    rows = frozen.join(features, key).join(known.select(key), key, "left_anti").withColumn("model_version", F.lit(version))
    return rows.withColumn("snapshot", content_hash({f.name: f.dataType.simpleString() for f in rows.schema.fields}))


def write_season(rows: DataFrame, path: str, season: str = "season") -> None:
    """Replace only the seasons that ``rows`` holds; earlier ones stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def write_deliverable(rows: DataFrame, path: str, digits: int = 5, codec: str = "gzip") -> None:
    """Rounded, compressed CSV."""
    cells = [F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("overwrite").option("compression", codec).csv(path, header=True)


def group_tops(edges: DataFrame, root: str = "root") -> DataFrame:
    """child, top and depth: the group below ``root`` that each node of a tree of (child, parent) hangs under."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE w(child, top, depth) AS (SELECT child, child, 1 FROM {edges} WHERE parent = {root}
        UNION ALL SELECT e.child, w.top, w.depth + 1 FROM {edges} e JOIN w ON e.parent = w.child) SELECT child, top, depth FROM w""",
        edges=edges, root=root,
    )
