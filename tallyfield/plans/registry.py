"""Registration of queries, and the test views as one text for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: In order of dependence. Contests are the first two suppliers of an order; points are quantities.
VIEWS = {
    "contest": """
WITH s AS (SELECT l_orderkey, l_suppkey AS team, SUM(l_quantity) AS pts, MIN(l_linenumber) AS ln FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT l_orderkey, team, pts, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY ln, team) AS rn FROM s),
g AS (SELECT a.l_orderkey AS game_id, a.team AS home_id, b.team AS away_id, a.pts AS home_score, b.pts AS away_score,
        o.o_orderdate + (a.l_orderkey % 12) * INTERVAL '1' HOUR AS kickoff, o.o_orderpriority
      FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2 JOIN orders o ON o.o_orderkey = a.l_orderkey)
SELECT game_id, CAST(year(kickoff) AS INT) AS season, kickoff, home_id, away_id, home_score, away_score,
  CASE WHEN game_id % 10 = 0 THEN 1 ELSE 0 END AS neutral, CASE WHEN home_id % 5 = away_id % 5 THEN 1 ELSE 0 END AS conf_game,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 81 ELSE 80 END AS feed_group,
  CASE WHEN game_id % 50 = 1 THEN kickoff - INTERVAL '1' HOUR WHEN game_id % 5 = 0 THEN kickoff + INTERVAL '2' HOUR
       ELSE kickoff + INTERVAL '30' DAY END AS collected FROM g""",
    "contest_avail": """
SELECT c.*, CASE WHEN collected > kickoff AND collected < kickoff + INTERVAL '270' MINUTE THEN collected
                 ELSE kickoff + INTERVAL '270' MINUTE END AS avail FROM contest c""",
    "obs": """
SELECT game_id, season, avail, kickoff, home_id AS off_id, away_id AS def_id, CASE WHEN neutral = 1 THEN 0 ELSE 1 END AS loc,
  home_score AS y, home_score - away_score AS margin FROM contest_avail
UNION ALL SELECT game_id, season, avail, kickoff, away_id, home_id, CASE WHEN neutral = 1 THEN 0 ELSE -1 END, away_score, away_score - home_score FROM contest_avail""",
    "entity_stats": """
SELECT l.l_orderkey AS game_id, l.l_suppkey AS team_id, COUNT(*) AS plays, AVG(l.l_extendedprice / l.l_quantity) AS price_pp,
  AVG(l.l_discount) AS disc_rate, AVG(CASE WHEN l.l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS return_rate,
  AVG(CASE WHEN l.l_linestatus = 'F' THEN l.l_tax END) AS tax_f FROM lineitem l GROUP BY l.l_orderkey, l.l_suppkey""",
    "play": """
SELECT user_id AS event_key, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_type AS type,
  CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'B' END AS off_side,
  CASE WHEN day(ts) <= 8 THEN 1 WHEN day(ts) <= 16 THEN 2 WHEN day(ts) <= 24 THEN 3 ELSE 4 END AS period,
  1 + event_id % 4 AS down, 1 + CAST(floor(value) AS BIGINT) % 20 AS dist, 1 + (event_id * 37) % 99 AS ytez,
  CAST(floor(value) AS BIGINT) % 25 AS yds,
  CASE WHEN event_type = 'purchase' THEN (CASE WHEN value >= 50 THEN 7 ELSE 3 END) ELSE 0 END AS score_value, props FROM events""",
    "prediction": """
SELECT game_id * 2 AS pred_id, game_id, 'v1.0' AS model_version, 'live' AS origin, kickoff - INTERVAL '3' HOUR AS created, kickoff,
  1e0 / (1e0 + exp(-(5e-2 * (home_score - away_score) + ((game_id * 7919) % 1000 - 500) / 250e0))) AS p_home,
  5e-1 * (home_score - away_score) + ((game_id * 104729) % 41 - 20) AS pred_margin, 50e0 AS pred_total FROM contest
UNION ALL
SELECT game_id * 2 + 1, game_id, 'v1.1', CASE WHEN game_id % 7 = 0 THEN 'backtest' ELSE 'live' END, kickoff - INTERVAL '2' HOUR, kickoff,
  1e0 / (1e0 + exp(-(5e-2 * (home_score - away_score) + ((game_id * 7919) % 1000 - 500) / 400e0))),
  6e-1 * (home_score - away_score) + ((game_id * 104729) % 31 - 15), 52e0 FROM contest""",
    "graded": """
SELECT p.*, c.season, c.home_id, c.away_id, c.neutral, c.conf_game, CASE WHEN c.home_score > c.away_score THEN 1 ELSE 0 END AS home_win,
  c.home_score - c.away_score AS margin, c.home_score + c.away_score AS total FROM prediction p JOIN contest c ON p.game_id = c.game_id""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _used(sql: str, kept=()) -> list[str]:
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and name not in kept and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in need]


def with_views(sql: str, kept=()) -> str:
    """``sql`` behind the views that it names; those of ``kept`` are tables."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in _used(sql, kept)]
    body = sql.strip()
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        body = ", " + body[len("WITH RECURSIVE ") if recursive else len("WITH ") :].lstrip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


class Tables:
    """The tables of a folder and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def keep(self, name: str) -> None:
        """From now on the view is read from files, and so are the views over it; a query that reads it several times makes it once."""
        if name not in self.kept:
            self.kept[name] = stored(self.sql(f"SELECT * FROM {name}", {"lineitem": "l_orderkey"}), name)  # lines move once, to those of their order

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.kept:
            return self.kept[name]
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str, by: dict[str, str] | None = None) -> DataFrame:
        """What ``text`` gives, with tables dealt out ``by`` a column first."""
        text = with_views(text, self.kept)
        used = [t for t in (*TABLES, *self.kept) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self[t].repartition(by[t]) if by and t in by else self[t] for t in used})


def query(name: str, sql: str | None = None):
    """Register the decorated function of ``Tables`` as a query, and its SQL, if any."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return add
