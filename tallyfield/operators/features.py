"""Point-in-time features of contests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def both_sides(contests: DataFrame, ratings: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``ratings`` (keys, team, values) joined for the home and for the away side."""
    for side in ("home", "away"):
        r = ratings.select(*keys, F.col("team").alias(f"{side}_id"), *(F.col(v).alias(f"{v}_{side}") for v in values))
        contests = contests.join(r, [*keys, f"{side}_id"], "left")
    return contests


def with_targets(features: DataFrame, contests: DataFrame) -> DataFrame:
    h, a = F.col("home_score"), F.col("away_score")
    return features.join(contests.select("game_id", (h - a).alias("margin"), (h + a).alias("total"), (h > a).cast("int").alias("home_win")), "game_id")


def season_summary(obs: DataFrame) -> DataFrame:
    """Means by place, strength of the opponents, a weighted mean, and the opponents in order."""
    mine = obs.groupBy("season", "off_id").agg(F.avg("margin").alias("opp"))
    x = obs.join(mine.select("season", F.col("off_id").alias("def_id"), "opp"), ["season", "def_id"])
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kickoff", "game_id", "def_id"))), lambda s: s["def_id"].cast("string")), "-")
    return x.groupBy("season", F.col("off_id").alias("team")).agg(
        F.count("*").alias("n"), F.avg("y").alias("ppg"), F.avg("margin").alias("margin"), F.avg(F.when(F.col("loc") == 1, F.col("margin"))).alias("home_margin"), F.avg(F.when(F.col("loc") == -1, F.col("margin"))).alias("away_margin"),
        F.avg("opp").alias("sos"), (F.sum(F.col("margin") * F.col("y")) / F.sum("y")).alias("weighted"), order.alias("opponents"),
    )


def expected_points(mu: Column, h: Column, neutral: Column, o_h: Column, d_h: Column, o_a: Column, d_a: Column) -> dict[str, Column]:
    """Points of both sides of a matchup, their difference and sum."""
    place = F.when(neutral == 1, F.lit(0.0)).otherwise(h)
    home, away = mu + o_h + d_a + place, mu + o_a + d_h - place
    return {"pp_home": home, "pp_away": away, "pts_margin": home - away, "pts_total": home + away, "abs_margin": F.abs(home - away)}


def matchups(metrics: list[str]) -> list[Column]:
    """(o_h + d_a) - (o_a + d_h) for each metric."""
    c = lambda k, m, s: F.col(f"{k}_{m}_{s}")
    return [((c("o", m, "home") + c("d", m, "away")) - (c("o", m, "away") + c("d", m, "home"))).alias(f"mx_{m}") for m in metrics]


def stale(cached: DataFrame, visible_now: DataFrame, contests: DataFrame) -> DataFrame:
    """game_id and action: ``build`` where the row is missing or the number of facts visible at its cutoff has changed, ``drop``
    where the contest is gone."""
    known = cached.select("game_id", F.col("visible").alias("_was"))
    live = contests.select("game_id", "cutoff").join(visible_now, "cutoff")
    both = live.join(known, "game_id", "full")
    action = F.when(F.col("cutoff").isNull(), "drop").when(~F.col("visible").eqNullSafe(F.col("_was")), "build")
    return both.select("game_id", action.alias("action")).where("action IS NOT NULL")


def audit(stored: DataFrame, rebuilt: DataFrame, keys: list[str], features: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Features whose rebuilt value differs from the stored one, with both."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("_f")).select(*keys, "_f.feature", F.col("_f.v").alias(name))
    both = long(stored, "stored").join(long(rebuilt, "rebuilt"), [*keys, "feature"], "full")
    same = F.col("stored").eqNullSafe(F.col("rebuilt")) | (F.abs(F.col("stored") - F.col("rebuilt")) <= tolerance * F.greatest(F.lit(1.0), F.abs("rebuilt")))
    return both.where(~F.coalesce(same, F.lit(False)))


def edges(rows: DataFrame, id: str, features: dict[str, int], pick: str, k: int = 3) -> DataFrame:
    """The ``k`` features of each contest that stand out most, in standard deviations, signed so that more is better for home.
    The mean and deviation are one row of aggregates."""
    stats = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = [F.struct(F.lit(c).alias("feature"), (sign * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias("z")) for c, sign in features.items()]
    long = rows.join(F.broadcast(stats)).select(id, pick, F.explode(F.array(*z)).alias("_e")).select(id, pick, "_e.feature", "_e.z").where("z IS NOT NULL")
    first = F.row_number().over(W.partitionBy(id).orderBy(F.abs("z").desc(), "feature"))
    return long.withColumn("k", first).where(F.col("k") <= k).withColumn("favours_pick", (F.col("z") >= 0) == (F.col(pick) >= 0.5)).drop(pick)


def risk_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items())))


def build(targets: DataFrame, obs: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row for each (contest, cutoff) of ``targets`` (game_id, season, cutoff, kickoff, home_id, away_id, neutral): expected
    points from ``ratings`` (as_of, season, team, mu, h, o, d; the latest by the cutoff), and form, rest and counts of visible facts.
    Facts and ratings are stacked with the two sides of each target, so one window sees them all, and both sides are brought together by a group of
    two rows. A row of the window carries the three newest facts only, by when they were played, however late each became available."""
    from .availability import running_asof

    asked = [r[0] for r in targets.select("season").distinct().collect()]  # a few; facts of other seasons are seen by none
    of_asked = F.coalesce(F.col("season").isin([s for s in asked if s is not None]), F.lit(None in asked))
    obs, ratings = obs.where(of_asked), ratings.where(of_asked)
    late = targets.where(F.col("cutoff") > F.col("kickoff"))
    if not late.isEmpty():
        raise ValueError("a cutoff lies after its contest begins")
    facts = obs.select("season", F.col("off_id").alias("team"), "avail", "margin", "y", F.col("kickoff").alias("played"))
    state = ratings.select("season", "team", F.col("as_of").alias("avail"), "mu", "h", "o", "d")
    own = ["game_id", "side", "kickoff", "home_id", "away_id", "neutral"]
    sides = targets.select("*", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("team")) for s in ("home", "away")))).alias("_s")).select("season", "cutoff", "_s.team", *(f"_s.{c}" if c == "side" else c for c in own))
    fact = F.when(F.col("_played").isNotNull(), F.struct("_played", "_margin"))
    latest = lambda v: lambda w: F.last(f"_{v}", ignorenulls=True).over(w)
    values = {"n": lambda w: F.count("_y").over(w), "points": lambda w: F.avg("_y").over(w), "last": lambda w: F.max("_played").over(w), **{v: latest(v) for v in ("mu", "h", "o", "d")}}
    seen = running_asof(sides, facts.unionByName(state, allowMissingColumns=True), ["team", "season"], values, target_id=own, greatest=("recent", fact, 3))
    margins = [F.col(f"recent_{i}._margin") for i in (1, 2, 3)]
    seen = seen.withColumn("form3", sum((F.coalesce(m, F.lit(0.0)) for m in margins), F.lit(0.0)) / F.nullif(sum((m.isNotNull().cast("int") for m in margins), F.lit(0)), F.lit(0)))
    of = lambda c, s: F.any_value(F.when(F.col("side") == s, F.col(c)), ignoreNulls=True).alias(f"{c}_{s}")
    held = [of(c, s) for s in ("home", "away") for c in ("n", "form3", "last", "mu", "h", "o", "d")]
    out = seen.groupBy("game_id", "cutoff", "season", "kickoff", "home_id", "away_id", "neutral").agg(*held)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ep = expected_points(zero(F.col("mu_home")), zero(F.col("h_home")), F.col("neutral"), *(zero(F.col(c)) for c in ("o_home", "d_home", "o_away", "d_away")))
    days = lambda s: F.floor(F.timestamp_diff("SECOND", F.col(f"last_{s}"), F.col("kickoff")) / 86400)
    rest = lambda s: F.when(F.col(f"last_{s}").isNull(), 14).otherwise(F.least(days(s), F.lit(21))).cast("long")
    return out.select(
        "game_id", "cutoff", "season", *(c.alias(k) for k, c in ep.items()), "n_home", "n_away", F.coalesce("form3_home", F.lit(0.0)).alias("form3_home"), F.coalesce("form3_away", F.lit(0.0)).alias("form3_away"),
        (F.coalesce("form3_home", F.lit(0.0)) - F.coalesce("form3_away", F.lit(0.0))).alias("form_diff"), rest("home").alias("rest_home"), rest("away").alias("rest_away"), (F.col("n_home") + F.col("n_away") < 4).cast("int").alias("early"),
    )


def scale_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("_f"))
    return long.groupBy(F.col("_f.feature").alias("feature")).agg(F.avg("_f.x").alias("mean"), F.stddev_samp("_f.x").alias("std"))




def runs(rows: DataFrame, keys: list[str], order: list[str], by: str, into: str) -> DataFrame:
    """``into``: the values of ``by`` in order, equal neighbours as one with their number, such as ``A x3 > B``; and the last value, and whether it differs from
    the one before. Rows without a value are passed over. Runs are counted first, so a text is joined from runs, not from rows."""
    from .sequence import islands

    numbered = islands(rows.where(F.col(by).isNotNull()), keys, order, by)
    at = F.struct(*order)
    run = numbered.groupBy(*keys, "island").agg(F.first(by).alias("_v"), F.count("*").alias("_n"), F.max(at).alias("_at"))
    text = F.concat(F.col("_v").cast("string"), F.when(F.col("_n") > 1, F.concat(F.lit(" x"), F.col("_n").cast("string"))).otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", text.alias("t")))), lambda s: s["t"]), " > ")
    last = F.max(F.struct("_at", "_v", "_n", "island"))
    out = run.groupBy(*keys).agg(joined.alias(into), last.alias("_last"))
    return out.select(*keys, into, F.col("_last._v").alias(f"last_{by}"), ((F.col("_last._n") == 1) & (F.col("_last.island") > 1)).cast("int").alias(f"{by}_changed"))


def season_report(obs: DataFrame, box: DataFrame, starters: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row for each (season, team): record, points and margins by place, the last margins, strength of the opponents met by ``ratings`` (season, team, r), shares
    of the ``box`` (game_id, team, and the sums third_conv, third_att, red_trips, red_rate, turnovers, fg_made, fg_att) weighted by their attempts, the opponents'
    turnovers, and the line of the latest starter of ``starters`` (season, team, game_id, kickoff, starter, attempts, gain). Every part is an aggregate by
    season and team before it is joined; a game without a box or starter counts where it can."""
    keys, order = ["season", "team"], ["kickoff", "game_id"]
    o = obs.select("season", F.col("off_id").alias("team"), F.col("def_id").alias("other"), *order, "loc", "y", "margin")
    margin, place = F.col("margin"), F.col("loc")
    opponents = ratings.select("season", F.col("team").alias("other"), "r")
    recent = lambda n: F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("_back") <= 5, F.struct("_back", "margin"))), True), 1, n), lambda s: F.floor(s["margin"]).cast("string")), ",")
    back = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    results = o.withColumn("_back", back).join(opponents, ["season", "other"], "left").groupBy(*keys).agg(
        F.count("*").alias("games"), F.count_if(margin > 0).alias("wins"), F.count_if(margin < 0).alias("losses"), F.avg("y").alias("ppg"), F.avg(F.col("y") - margin).alias("opp_ppg"), F.avg(margin).alias("avg_margin"),
        F.avg(F.when(place == 1, margin)).alias("home_margin"), F.count_if(place == 1).alias("n_home"), F.avg(F.when(place == -1, margin)).alias("away_margin"), F.count_if(place == -1).alias("n_away"),
        recent(3).alias("last3"), recent(5).alias("last5"), F.avg("r").alias("sos"),
    )
    mine = o.select(*keys, "game_id", "other").join(box, ["game_id", "team"], "left")
    theirs = box.select("game_id", F.col("team").alias("other"), F.col("turnovers").alias("taken"))
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    sums = mine.join(theirs, ["game_id", "other"], "left").groupBy(*keys).agg(
        share("third_conv", "third_att").alias("third_down"), share(F.col("red_rate") * F.col("red_trips"), F.when(F.col("red_rate").isNotNull(), F.col("red_trips"))).alias("red_zone"), F.avg("turnovers").alias("turnovers_pg"),
        F.avg("taken").alias("takeaways_pg"), (F.avg("taken") - F.avg("turnovers")).alias("turnover_margin"), F.sum("fg_made").alias("fg_made"), F.sum("fg_att").alias("fg_att"),
    )
    known = starters.where("starter IS NOT NULL")
    sequence = runs(known, keys, order, "starter", "starter_sequence")
    line = known.join(sequence.select(*keys, "last_starter"), keys).groupBy(*keys).agg(
        F.count_if(F.col("starter") == F.col("last_starter")).alias("starts"), F.sum(F.when(F.col("starter") == F.col("last_starter"), F.col("attempts"))).alias("starter_attempts"),
        F.sum(F.when(F.col("starter") == F.col("last_starter"), F.col("gain"))).alias("_gain"), F.sum("attempts").alias("_all"),
    )
    mine = F.col("starter_attempts")
    line = line.select(*keys, "starts", "starter_attempts", F.when(mine > 0, F.col("_gain") / mine).alias("starter_gain"), F.when(F.col("_all") > 0, mine / F.col("_all")).alias("starter_share"))
    return results.join(sums, keys, "left").join(sequence, keys, "left").join(line, keys, "left")


def unit_ratings(contests: DataFrame, ratings: DataFrame, metrics: list[str], environment: list[str]) -> DataFrame:
    """game_id and, of each metric in ``ratings`` (season, team, metric, o, d), the ratings of both sides' units, the matchup of their differences, and for
    ``environment`` what each side's offence meets: its own rating and the other's defence. A side without ratings has nulls."""
    wide = ratings.groupBy("season", "team").pivot("metric", metrics).agg(F.first("o").alias("o"), F.first("d").alias("d"))
    return units(contests, wide.select("season", "team", *(F.col(f"{m}_{u}").alias(f"{u}_{m}") for m in metrics for u in "od")), metrics, environment)


def mean_units(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """season, team and for each metric o_<metric> and d_<metric>: its means where the side is off_id and where it is def_id, both null unless there are both. ``rows`` have
    a column for each metric, so that a row is read once, for both of its sides and all metrics."""
    sides = F.inline(F.array(F.struct(F.col("off_id").alias("team"), F.lit("o").alias("_u")), F.struct(F.col("def_id").alias("team"), F.lit("d").alias("_u"))))
    means = rows.select("season", *metrics, sides).groupBy("season", "team").agg(*(F.avg(F.when(F.col("_u") == u, F.col(m))).alias(f"{u}_{m}") for m in metrics for u in "od"))
    return means.select("season", "team", *(F.when(F.col(f"{v}_{m}").isNotNull(), F.col(f"{u}_{m}")).alias(f"{u}_{m}") for m in metrics for u, v in ("od", "do")))


def units(contests: DataFrame, wide: DataFrame, metrics: list[str], environment: list[str]) -> DataFrame:
    """The same from a row for each (season, team) with o_<metric> and d_<metric>."""
    both = both_sides(contests, wide, ["season"], [f"{u}_{m}" for m in metrics for u in "od"])
    units = [f"{u}_{m}_{s}" for m in metrics for u in "od" for s in ("home", "away")]
    against = [(F.col(f"o_{m}_{a}") + F.col(f"d_{m}_{b}")).alias(f"env_{m}_{a}") for m in environment for a, b in (("home", "away"), ("away", "home"))]
    return both.select("game_id", *units, *matchups(metrics), *against)


def injury_counts(reports: DataFrame, key_positions: tuple[str, ...]) -> DataFrame:
    """game_id, team, how many players are out or doubtful, and how many of these at a key position, from ``reports`` (game_id, team, player, pos, status)."""
    missing = reports.where(F.col("status").isin("Out", "Doubtful"))
    return missing.groupBy("game_id", "team").agg(F.count("*").alias("out"), F.count_if(F.col("pos").isin(*key_positions)).alias("key_out"))


def all_risks(picks: DataFrame, edges_of: DataFrame, starters: DataFrame, injuries: DataFrame, many: int = 4) -> DataFrame:
    """game_id and its flags in order, from ``picks`` (game_id, home_id, away_id, split, early), the signed edges (game_id, feature, z, k, favours_pick), starters (game_id, team,
    changed) and injuries (game_id, team, out, key_out): members that split, the strongest edge against the pick, changed starters, an early season, key players and
    ``many`` players out, and where there is none of these the variance of a single contest."""
    counter = edges_of.where("NOT favours_pick").groupBy("game_id").agg(F.min_by("feature", "k").alias("counter"))
    rows = picks.join(counter, "game_id", "left")
    for s in ("home", "away"):
        rows = rows.join(starters.select("game_id", F.col("team").alias(f"{s}_id"), F.col("changed").alias(f"changed_{s}")), ["game_id", f"{s}_id"], "left")
        rows = rows.join(injuries.select("game_id", F.col("team").alias(f"{s}_id"), F.col("out").alias(f"out_{s}"), F.col("key_out").alias(f"key_{s}")), ["game_id", f"{s}_id"], "left")
    flag = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text)
    each = [flag(F.col("split"), F.lit("members split")), F.when(F.col("counter").isNotNull(), F.concat(F.lit("counter "), "counter"))]
    each += [flag(F.col(f"changed_{s}") == 1, F.lit(f"starter changed {s}")) for s in ("home", "away")] + [flag(F.col("early") == 1, F.lit("early season"))]
    each += [flag(c, text) for s in ("home", "away") for c, text in ((F.col(f"key_{s}") > 0, F.lit(f"key player out {s}")), (F.col(f"out_{s}") >= many, F.concat(F.col(f"out_{s}").cast("string"), F.lit(f" players out {s}"))))]
    found = F.array_compact(F.array(*each))
    return rows.select("game_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("single contest"))).alias("flags"))
