"""Stored features that follow late facts, a log of predictions that is only appended to, and its audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.parted import PartedTable
from ..sources.shared import checkpointed
from .availability import visible_counts
from .features import stale
from .tables import content_hash, insert_new


def refresh(store: PartedTable, version: int, targets: DataFrame, facts: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that were stale, as (game_id, action, season). A stored row is stale if the number of facts visible at its cutoff has changed, or
    its contest is gone; a missing one is built. Only stale rows are built, and only the parts that hold or get them are written anew. ``store`` has
    ``visible`` beside what ``build`` returns for targets (game_id, season, cutoff, ...); a store that is up to date gets no new version."""
    stored = store.read(version=version)
    now = visible_counts(targets.select("cutoff"), facts)
    actions = stale(stored.select("game_id", "visible"), now, targets.select("game_id", "cutoff"))
    where = stored.select("game_id", store.part).unionByName(targets.select("game_id", store.part)).distinct()
    actions = checkpointed(actions.join(where, "game_id"))
    parts = store.parts_of(actions)
    if parts:
        todo = targets.join(actions.where("action = 'build'").select("game_id").distinct(), "game_id", "left_semi")
        built = build(todo).join(now, "cutoff").select(*store.schema.names)
        kept = store.read(parts, version).join(actions.select("game_id").distinct(), "game_id", "left_anti")
        store.replace(version, kept.select(*store.schema.names).unionByName(built), parts)
    return actions


#: What a logged prediction is known by, besides the hash of its inputs.
LOGGED = ("game_id", "model_version", "origin", "home_id", "away_id", "input_sha256")


def predictions(slate: DataFrame, now: Column, version: str, build: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], features: list[str], backtest: bool = False) -> DataFrame:
    """One row for each contest of ``slate``: features at the cutoff, which is the earlier of ``now`` and the contest's start (so a back-test has one for each
    start), the prediction from these, the hash of the features, and the hash of all that the prediction stands for. A pick is blind if it is live
    and made before the start."""
    targets = slate.withColumn("cutoff", F.least(now, F.col("kickoff")))
    rows = score(build(targets)).drop("kickoff", "home_id", "away_id").join(targets.select("game_id", "kickoff", "home_id", "away_id"), "game_id")
    origin = "backtest" if backtest else "live"
    blind = F.lit(False) if backtest else now < F.col("kickoff")
    rows = rows.select("*", now.alias("created"), F.lit(version).alias("model_version"), F.lit(origin).alias("origin"), blind.alias("is_blind"))
    return with_hashes(rows, features)


def with_hashes(rows: DataFrame, features: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    about = {c: kinds[c] for c in ("cutoff", "model_version", "game_id", "home_id", "away_id")}
    return rows.withColumn("input_sha256", content_hash({f: kinds[f] for f in features})).withColumn("snapshot_sha256", content_hash({f: kinds[f] for f in features} | about))


def append_predictions(log: PartedTable, version: int, rows: DataFrame) -> int:
    """Adds the predictions that the log lacks, and says how many. One of the same contest, model, origin, sides and inputs is the same, whenever it was
    made, and keeps its first row; a null contest equals itself."""
    rows = checkpointed(rows.select(*log.schema.names))
    known = log.read(log.parts_of(rows), version)
    new = checkpointed(insert_new(known.where("false"), rows, list(LOGGED)).join(known.select(*(F.col(k).alias(f"_{k}") for k in LOGGED)), _same(), "left_anti"))
    count = new.count()
    if count:
        log.append(version, new)
    return count


def _same() -> Column:
    out = F.lit(True)
    for k in LOGGED:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def fact_digests(facts: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A tree of digests: one row (level, *group, n, digest) for each group, each value of the first key, and all facts. A digest is the sum of the hashes of
    the rows, so it doesn't depend on their order and parents follow from children."""
    leaves = facts.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*group, *columns).cast("decimal(38,0)")).alias("digest"))
    tree, level = leaves.withColumn("level", F.lit(len(group))), leaves
    for depth in range(len(group) - 1, -1, -1):
        level = level.groupBy(*group[:depth]).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
        tree = tree.unionByName(level.withColumn("level", F.lit(depth)), allowMissingColumns=True)
    return tree.select("level", *group, "n", "digest")


def changed_groups(before: DataFrame, after: DataFrame, group: list[str]) -> DataFrame:
    """The groups whose facts differ between two trees, from the root down: only what lies below a differing digest is compared further."""
    above = None
    for depth in range(len(group) + 1):
        keys = group[:depth]
        was, now = (t.where(F.col("level") == depth).select(*keys, F.struct("n", "digest").alias(side)) for t, side in ((before, "_was"), (after, "_now")))
        if above is not None:
            was, now = (t.join(above, group[: depth - 1], "left_semi") if depth > 1 else t for t in (was, now))
        both = was.join(now, keys, "full") if keys else was.join(now, how="full")
        above = checkpointed(both.where(~F.col("_was").eqNullSafe(F.col("_now"))).select(*keys))
        if above.isEmpty():
            return after.where("false").select(*group)
    return above


def audit(log: DataFrame, build: Callable[[DataFrame], DataFrame], features: list[str], tolerance: float = 1e-6, changed: DataFrame | None = None) -> DataFrame:
    """What is wrong with logged predictions: features that differ from those built anew at the stored cutoff from today's facts (feature), contests that
    can't be built (missing), snapshots that don't have their hash (hash), and cutoffs after the start or blind picks made after it (timestamp).

    ``changed`` (season, team): the groups of facts that changed since an earlier audit; then only contests of these are built again, as for all others
    the builder would see what it saw. Values that are null on either side aren't compared. A log with repeated rows gives repeated findings."""
    late = (F.col("cutoff") > F.col("kickoff")) | (F.col("is_blind") & (F.col("created") >= F.col("kickoff")))
    no = F.lit(None).cast("double")
    finding = lambda rows, kind, feature=F.lit(None).cast("string"), stored=no, rebuilt=no: rows.select("game_id", "cutoff", F.lit(kind).alias("kind"), feature.alias("feature"), stored.alias("stored"), rebuilt.alias("rebuilt"))
    rows = log.where("cutoff <= kickoff")
    if changed is not None:
        sides = [changed.select("season", F.col("team").alias(f"{s}_id"), F.lit(True).alias(f"_{s}")).distinct() for s in ("home", "away")]
        rows = rows.join(sides[0], ["season", "home_id"], "left").join(sides[1], ["season", "away_id"], "left").where("_home OR _away").drop("_home", "_away")
    targets = rows.select("game_id", "season", "kickoff", "cutoff", "home_id", "away_id", "neutral").dropDuplicates(["game_id", "cutoff"])
    built = build(targets).select("game_id", "cutoff", F.struct(*(F.col(f).cast("double").alias(f) for f in features)).alias("_now"))
    both = rows.join(built, ["game_id", "cutoff"], "left")
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("stored"), F.col(f"_now.{f}").alias("rebuilt")) for f in features)))
    differing = both.where("_now IS NOT NULL").select("game_id", "cutoff", each).where(F.abs(F.col("stored") - F.col("rebuilt")) > tolerance * F.greatest(F.lit(1.0), F.abs("stored")))
    again = with_hashes(log.withColumnRenamed("snapshot_sha256", "_stored"), features)
    return (
        finding(differing, "feature", F.col("feature"), F.col("stored"), F.col("rebuilt"))
        .unionByName(finding(both.where("_now IS NULL"), "missing"))
        .unionByName(finding(again.where(~F.col("_stored").eqNullSafe(F.col("snapshot_sha256"))), "hash"))
        .unionByName(finding(log.where(late), "timestamp"))
    )
