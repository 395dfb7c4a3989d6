"""Members, ensembles, calibration and walk-forward evaluation with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import checkpointed
from .boosting import BoostedTrees, Settings, boost


@dataclass(frozen=True)
class Policy:
    """Thresholds of promotion; a domain overrides what differs with ``replace``."""

    high_conf: float = 0.75
    n_folds: int = 6
    confirm_folds: int = 2
    min_new: int = 100
    min_confirm: int = 300
    min_gain: float = 0.002
    alpha: float = 0.05
    max_candidates: int = 8
    max_ece_worsening: float = 0.01
    eval_window: int = 3000

    def for_domain(self, **changes) -> Policy:
        return replace(self, **changes)


@dataclass(frozen=True)
class Config:
    """What a model is made of. ``members``: name -> settings; the name is looked up in ``MEMBERS``."""

    features: tuple[str, ...]
    members: dict = field(default_factory=lambda: {"logistic": {"C": 0.1}, "margin_ridge": {"alpha": 10.0}})
    ensemble: str = "weights"
    calibration: str = "none"
    half_life_days: float | None = None
    stack_context: tuple[str, ...] = ()

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, default=list)


def assembled(rows: DataFrame, features: list[str], into: str = "x") -> DataFrame:
    """A vector of the features; null and NaN become 0."""
    safe = rows.select("*", *(F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)).alias(f"_f_{f}") for f in features))
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol=into).transform(safe).drop(*(f"_f_{f}" for f in features))


def _weighted(rows: DataFrame) -> DataFrame:
    return rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))


@dataclass(frozen=True)
class Fitted:
    """A member: ``score`` adds p_<name>, m_<name> or both. One that predicts margins only, and whose ``chance`` is set, gets p from the
    normal distribution of its residuals; ``margin`` is a second model, of margins, beside one of probabilities."""

    name: str
    model: PipelineModel
    features: tuple[str, ...]
    sigma: float | None = None
    margin: PipelineModel | None = None
    chance: bool = True

    @property
    def has_margin(self) -> bool:
        return self.sigma is not None or self.margin is not None

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(assembled(rows, list(self.features), "_x"))
        if self.sigma is None:
            out = out.withColumn(f"p_{self.name}", vector_to_array("probability")[1])
        else:
            out = out.withColumn(f"m_{self.name}", F.col("prediction"))
            if self.chance:
                out = out.withColumn(f"p_{self.name}", S.normal_cdf(F.col("prediction") / self.sigma))
        out = out.drop("_z", "rawPrediction", "probability", "prediction")
        if self.margin is not None:
            out = self.margin.transform(out).withColumn(f"m_{self.name}", F.col("prediction")).drop("_z", "prediction")
        return out.drop("_x")


def together(rows: DataFrame, jobs: list[Callable], parallelism: int = 4) -> list:
    """What the functions return. Their Spark jobs don't depend on each other, so the driver submits those of several at a time."""
    if len(jobs) < 2 or parallelism < 2:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(lambda job: job()), jobs)


def _standard() -> StandardScaler:
    return StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)


def _spread(rows: DataFrame, error: Column) -> float:
    """Root of the weighted mean square of an error, never 0."""
    return max(rows.agg(F.sqrt(F.sum(F.col("weight") * error * error) / F.sum("weight"))).first()[0] or 1.0, 1e-6)


def _ridge(rows: DataFrame, target: str, alpha: float, features: str) -> LinearRegression:
    """Weighted squares plus alpha times the squared coefficients: Spark divides the first by the sum of weights and the penalty by the
    label's deviation, so both are undone here."""
    y, w = F.col(target).cast("double"), F.col("weight")
    s = rows.agg(F.sum(w).alias("w"), (F.sum(w * y) / F.sum(w)).alias("mean"), (F.sum(w * y * y) / F.sum(w)).alias("square")).first()
    spread = max((s["square"] or 0.0) - (s["mean"] or 0.0) ** 2, 0.0) ** 0.5
    return LinearRegression(featuresCol=features, labelCol=target, weightCol="weight", regParam=alpha * (spread or 1.0) / (s["w"] or 1.0), elasticNetParam=0.0, standardization=False, solver="normal")


def logistic(rows: DataFrame, features: tuple[str, ...], name: str = "logistic", C: float = 0.1) -> Fitted:
    """Standardised logistic regression; the penalty matches C times the sum of losses."""
    rows = _weighted(rows)
    total = rows.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="_z", labelCol="home_win", weightCol="weight", regParam=1 / (C * total), standardization=False, maxIter=200, tol=1e-10)
    return Fitted(name, Pipeline(stages=[_standard(), lr]).fit(assembled(rows, list(features), "_x")), tuple(features))


def margin_ridge(rows: DataFrame, features: tuple[str, ...], name: str = "margin_ridge", alpha: float = 10.0, target: str = "margin") -> Fitted:
    """Ridge on standardised features."""
    base = assembled(_weighted(rows), list(features), "_x")
    model = Pipeline(stages=[_standard(), _ridge(base, target, alpha, "_z")]).fit(base)
    return Fitted(name, model, tuple(features), _spread(model.transform(base), F.col(target) - F.col("prediction")))


def elo_member(rows: DataFrame, features: tuple[str, ...] = ("elo_diff",), name: str = "elo") -> Fitted:
    """Probability and margin from the difference of ratings alone, both all but without penalty."""
    base = assembled(_weighted(rows), list(features), "_x")
    lr = LogisticRegression(featuresCol="_x", labelCol="home_win", weightCol="weight", regParam=0.0, maxIter=100)
    return Fitted(name, Pipeline(stages=[lr]).fit(base), tuple(features), margin=Pipeline(stages=[_ridge(base, "margin", 1e-6, "_x")]).fit(base))


def _boosted(base: DataFrame, label: str, features: tuple[str, ...], chance: bool, settings: dict) -> PipelineModel:
    booster = boost(base, label, len(features), chance, Settings(**settings))
    return PipelineModel([BoostedTrees(booster=booster.text())])


def trees(rows: DataFrame, features: tuple[str, ...], name: str = "gbm", **settings) -> Fitted:
    """Boosted trees of the outcome; ``settings`` are those of the booster."""
    return Fitted(name, _boosted(assembled(_weighted(rows), list(features), "_x"), "home_win", features, True, settings), tuple(features))


def margin_trees(rows: DataFrame, features: tuple[str, ...], name: str = "gbm_margin", **settings) -> Fitted:
    """Boosted trees of the margin; they give no probability."""
    base = assembled(_weighted(rows), list(features), "_x")
    model = _boosted(base, "margin", features, False, settings)
    return Fitted(name, model, tuple(features), _spread(model.transform(base), F.col("margin") - F.col("prediction")), chance=False)


#: Member types by name: an extension adds its own.
MEMBERS: dict[str, Callable[..., Fitted]] = {"logistic": logistic, "margin_ridge": margin_ridge, "elo": elo_member, "gbm": trees, "gbm_margin": margin_trees}


def scoring_member(rows: DataFrame, predicted: str = "pred_margin", target: str = "margin") -> DataFrame:
    """One row: slope, intercept and residual deviation of the target on a predicted margin."""
    x, y = F.col(predicted), F.col(target)
    fit = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.var_pop(y).alias("_vy"), F.corr(y, x).alias("_r"))
    return fit.select("slope", "intercept", F.sqrt(F.col("_vy") * (1 - F.col("_r") * F.col("_r"))).alias("sigma"))


def contributions(member: Fitted, rows: DataFrame, id: str) -> DataFrame:
    """z times coefficient of each feature of a linear member."""
    out = member.model.transform(assembled(rows, list(member.features), "_x"))
    beta = F.array(*(F.lit(float(c)) for c in member.model.stages[-1].coefficients))
    parts = F.zip_with(vector_to_array("_z"), beta, lambda z, b: z * b)
    return out.select(id, F.explode(F.map_from_arrays(F.array(*map(F.lit, member.features)), parts)).alias("feature", "contribution"))


#: So many rows are weighed by one task, which holds a number for each row and member; more take an aggregate for each step.
EM_ROWS = 4_000_000


def mixture_weights(rows: DataFrame, members: list[str], y: str = "home_win", rounds: int = 25) -> dict[str, float]:
    """Convex weights of probabilities that minimise log loss, by EM; a step needs as many sums as members. Steps are short jobs, so those
    over rows that a task can hold are one."""
    like = {m: F.when(F.col(y) == 1, F.col(m)).otherwise(1 - F.col(m)) for m in members}
    base = rows.select(*(S.clip(c, 1e-6, 1).alias(m) for m, c in like.items())).persist()
    w = dict.fromkeys(members, 1 / len(members))
    if base.count() <= EM_ROWS:
        w = _weighed_in_one(base, w, rounds)
        base.unpersist()
        return w
    for _ in range(rounds):
        mix = sum((F.lit(w[m]) * F.col(m) for m in members), F.lit(0.0))
        got = base.agg(*(F.avg(F.lit(w[m]) * F.col(m) / mix).alias(m) for m in members)).first()
        if got[0] is None:
            break
        w = got.asDict()
    base.unpersist()
    return w


def _weighed_in_one(base: DataFrame, w: dict[str, float], rounds: int) -> dict[str, float]:
    """The steps of EM in one task. A row without one of the values counts for none of the weights."""
    start = np.array([*w.values()])

    def weigh(batches):
        held = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) for batch in batches if batch.num_rows]
        p, at = np.concatenate([np.zeros((len(start), 0)), *held], axis=1), start
        p = p[:, ~np.isnan(p).any(axis=0)]
        for _ in range(rounds if p.shape[1] else 0):
            part = at[:, None] * p
            at = (part / part.sum(axis=0)).mean(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.float64()))], names=["w"])

    got = base.coalesce(1).mapInArrow(weigh, "w array<double>").collect()
    return dict(zip(w, got[0]["w"])) if got else w


def margin_weights(rows: DataFrame, members: list[str], target: str = "margin") -> dict[str, float]:
    """Convex weights of margins that minimise the squared error: one aggregate of products, then the best of the small
    problems over all subsets of members."""
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i:]]
    s = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs), *(F.sum(F.col(a) * F.col(target)).alias(f"{a}*y") for a in members)).first().asDict()
    g = np.array([[s[f"{a}*{b}"] if f"{a}*{b}" in s else s[f"{b}*{a}"] for b in members] for a in members])
    c = np.array([s[f"{a}*y"] for a in members])
    scale = max(float(np.abs(g).max()), 1e-300)  # sums grow with the rows; beside them the condition that weights add to 1 would count as nothing
    g, c = g / scale, c / scale
    best = None
    for size in range(1, len(members) + 1):
        for at in map(list, combinations(range(len(members)), size)):
            kkt = np.block([[g[np.ix_(at, at)] + 1e-9 / scale * np.eye(size), np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(kkt, np.append(c[at], 1), rcond=None)[0][:size]
            if (w >= -1e-12).all() and (best is None or w @ g[np.ix_(at, at)] @ w - 2 * c[at] @ w < best[0]):
                best = (w @ g[np.ix_(at, at)] @ w - 2 * c[at] @ w, dict(zip((members[i] for i in at), w.clip(0))))
    return {m: float(best[1].get(m, 0.0)) for m in members}


@dataclass(frozen=True)
class Calibrator:
    """Adds ``p_home`` to rows with a raw probability: that itself, or Platt's a + b times its logit, or an isotonic model, within .005 and .995."""

    kind: str = "none"
    a: float = 0.0
    b: float = 1.0
    model: IsotonicRegressionModel | None = None
    p: str = "p_raw"

    def __call__(self, rows: DataFrame) -> DataFrame:
        if self.kind == "none":
            return rows.withColumn("p_home", F.col(self.p))
        if self.kind == "platt":
            return rows.withColumn("p_home", S.clip(S.expit(self.a + self.b * S.logit(F.col(self.p))), 0.005, 0.995))
        return self.model.transform(rows).withColumn("p_home", S.clip(F.col("prediction"), 0.005, 0.995)).drop("prediction")


def calibrate(rows: DataFrame, kind: str, p: str = "p_raw", y: str = "home_win") -> Calibrator:
    """A calibrator fitted on the rows: Platt is a logistic fit on the logit."""
    if kind == "none":
        return Calibrator(p=p)
    if kind == "platt":
        base = rows.withColumn("_l", S.logit(F.col(p)))
        model = LogisticRegression(featuresCol="_v", labelCol=y, maxIter=100).fit(assembled(base, ["_l"], "_v"))
        return Calibrator(kind, float(model.intercept), float(model.coefficients[0]), p=p)
    return Calibrator(kind, model=IsotonicRegression(featuresCol=p, labelCol=y).fit(rows.withColumn(y, F.col(y).cast("double"))), p=p)


@dataclass(frozen=True)
class Ensemble:
    members: tuple[Fitted, ...]
    p_weights: dict
    m_weights: dict
    total: Fitted | None
    stacker: Fitted | None
    calibrator: Calibrator
    sigma: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Members, p_raw, p_home, pred_margin made to agree with it, pred_total, spread of the members and whether they split."""
        out = rows
        for m in self.members:
            out = m.score(out)
        ps, ms = list(self.p_weights), list(self.m_weights)
        if self.stacker is not None:
            out = self.stacker.score(with_logits(out, ps)).withColumnRenamed("p_stack", "p_raw").drop(*(f"l_{p}" for p in ps))
        else:
            out = out.withColumn("p_raw", sum((F.lit(self.p_weights[p]) * F.col(p) for p in ps), F.lit(0.0)))
        out = self.calibrator(out)
        margin = sum((F.lit(self.m_weights[m]) * F.col(m) for m in ms), F.lit(0.0)) if ms else self.sigma * S.normal_quantile(S.clip(F.col("p_home"), 0.001, 0.999))
        out = out.withColumn("pred_margin", S.consistent_margin(margin, F.col("p_home"), self.sigma))
        if self.total is not None:
            out = self.total.score(out).withColumnRenamed("m_total", "pred_total").drop("p_total")
        mean = sum((F.col(p) for p in ps), F.lit(0.0)) / len(ps)
        sd = F.sqrt(sum(((F.col(p) - mean) * (F.col(p) - mean) for p in ps), F.lit(0.0)) / max(1, len(ps) - 1))
        sides = [(F.col(p) >= 0.5).cast("int") for p in ps]
        split = (F.greatest(*sides) != F.least(*sides)) if len(ps) > 1 else F.lit(False)
        return out.withColumn("p_sd", sd).withColumn("split", split)


def with_logits(rows: DataFrame, ps: list[str]) -> DataFrame:
    return rows.select("*", *(S.logit(F.col(p)).alias(f"l_{p}") for p in ps))


def fit_ensemble(config: Config, rows: DataFrame, at: str = "kickoff", id: str = "game_id", known: dict | None = None) -> Ensemble:
    """Members on the older rows, their combination on the newest fifth, then members again on all. ``known`` keeps what was fitted on these rows; a
    configuration that comes with it later fits only what it doesn't have in common with those before."""
    from .folds import recency, split_newest

    known = {} if known is None else known

    def once(make, *key):
        if key not in known:
            known[key] = make()
        return known[key]

    rows = recency(rows, config.half_life_days, at) if config.half_life_days else _weighted(rows)
    weighted = config.half_life_days or None
    old, hold = (part.persist() for part in once(lambda: split_newest(rows, 0.2, None, 200, at, id), "parts", weighted))  # each member reads them several times
    names = tuple((k, json.dumps(v, sort_keys=True), () if k == "elo" else config.features) for k, v in config.members.items())
    fit = lambda df, k, v: MEMBERS[k](df, config.features, name=k, **v) if k != "elo" else elo_member(df, name=k)
    build = lambda df, part: tuple(once(partial(fit, df, k, v), part, weighted, name) for name, (k, v) in zip(names, config.members.items()))
    first = build(old, "old")
    old.unpersist()
    scored = hold
    for m in first:
        scored = m.score(scored)
    ps, ms = [f"p_{m.name}" for m in first if f"p_{m.name}" in scored.columns], [f"m_{m.name}" for m in first if m.has_margin]
    scored = scored.persist()

    def weights():
        m_weights = margin_weights(scored, ms) if ms else {}
        margin = sum((F.lit(m_weights[m]) * F.col(m) for m in ms), F.lit(0.0))
        return mixture_weights(scored, ps), m_weights, max(scored.agg(F.stddev_pop(F.col("margin") - margin)).first()[0] or 1.0, 1e-6)

    try:
        p_weights, m_weights, sigma = once(weights, "weights", weighted, names)
        stacker = None
        if config.ensemble == "stack":
            context = tuple(f"l_{p}" for p in ps) + tuple(config.stack_context)
            stacker = once(lambda: logistic(with_logits(scored, ps).drop("weight"), context, "stack", C=1.0), "stack", weighted, names, context)
            raw = stacker.score(with_logits(scored, ps)).withColumnRenamed("p_stack", "p_raw")
        else:
            raw = scored.withColumn("p_raw", sum((F.lit(p_weights[p]) * F.col(p) for p in ps), F.lit(0.0)))
        calibrator = calibrate(raw, config.calibration)
    finally:
        scored.unpersist()
        hold.unpersist()
    total = once(lambda: margin_ridge(rows.drop("weight"), config.features, "total", target="total"), "total", config.features)
    return Ensemble(build(rows, "all"), p_weights, m_weights, total, stacker, calibrator, sigma)


def walk_forward(config: Config, rows: DataFrame, policy: Policy = Policy(), at: str = "kickoff", avail: str = "avail", id: str = "game_id", parallelism: int = 4, known: dict | None = None) -> DataFrame:
    """Out-of-sample predictions of each fold, from models fitted on what was available when it starts. Folds don't depend on each other:
    the driver submits the jobs of ``parallelism`` of them at a time. ``known`` keeps, by the start of a fold, what was fitted for it."""
    from .folds import folds

    known = {} if known is None else known
    blocks = checkpointed(folds(rows, policy.n_folds, most=policy.eval_window, at=at, id=id))  # few rows, read for each fold
    starts = sorted((r["fold"], r["start"]) for r in blocks.groupBy("fold").agg(F.min(at).alias("start")).collect())

    def one(fold, start) -> DataFrame:
        model = fit_ensemble(config, rows.where(F.col(avail) <= F.lit(start)), at, id, known.setdefault(start, {}))
        return model.score(blocks.where(F.col("fold") == fold))

    parts = together(rows, [partial(one, *case) for case in starts], parallelism)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def permutation_importance(model: Ensemble, rows: DataFrame, features: list[str], repeats: int = 3, id: str = "game_id") -> DataFrame:
    """Rise of the log loss when a feature's values are dealt out anew. All features and repeats are one table, scored at once. The deal is
    within random parts of about 5,000 rows, which come together as a list each: in the order of ids, a row gets the value that has its place in the
    order of a seeded hash. So rows move once; ids are distinct."""
    parts = max(1, rows.count() // 5000)
    cases = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in features for r in range(repeats))))
    n = rows.select("*", cases.alias("_c")).select("*", "_c.feature", "_c.repeat").drop("_c").withColumn("_b", F.pmod(F.xxhash64(id, "feature", "repeat"), F.lit(parts)))
    read = [c for c in rows.columns if c in {id, "home_win", "weight", *features, *(c for m in (*model.members, model.total, model.stacker) if m for c in m.features)}]  # what is scored
    row, dealt = F.struct(id, *(c for c in read if c != id)), F.struct(F.xxhash64(F.lit(1), id, "feature", "repeat").alias("h"), F.col(id).alias("id"), *(F.col(f).alias(f"_o_{f}") for f in features))
    lists = n.groupBy("feature", "repeat", "_b").agg(F.array_sort(F.collect_list(row)).alias("_row"), F.array_sort(F.collect_list(dealt)).alias("_new"))
    long = lists.select("feature", "repeat", F.explode(F.arrays_zip("_row", "_new")).alias("_z")).select("feature", "repeat", "_z._row.*", *(F.col(f"_z._new._o_{f}") for f in features))
    long = long.select(*(F.when(F.col("feature") == c, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in features else c for c in read), "feature", "repeat")
    loss = S.log_loss(F.col("p_home"), F.col("home_win"))
    base = model.score(rows).agg(F.avg(loss)).first()[0]
    by = model.score(long).groupBy("feature", "repeat").agg((F.avg(loss) - F.lit(base)).alias("d"))
    return by.groupBy("feature").agg(F.avg("d").alias("delta"), (F.avg("d") <= 1e-12).alias("useless"))


#: When a finding of a kind is flagged, which change is proposed, in this order.
PROPOSALS = (
    ("calibration", "calibration_platt", {"calibration": "platt"}),
    ("calibration", "calibration_isotonic", {"calibration": "isotonic"}),
    ("subgroup", "stack_subgroup_context", {"ensemble": "stack"}),
    ("residual", "stack_residual_features", {"ensemble": "stack"}),
    ("residual", "more_capacity", {"capacity": "more"}),
    ("useless", "drop_useless_features", {"drop": "useless"}),
    ("dead", "drop_dead_members", {"drop": "dead"}),
    ("drift", "recency_weighting", {"half_life_days": 365}),
)


def propose(findings: DataFrame, most: int = 8) -> DataFrame:
    """Candidates for the flagged findings (kind, subject, flagged): rule order, one of each change, the first ``most``."""
    rules = findings.sparkSession.createDataFrame([(i, k, n, json.dumps(c, sort_keys=True)) for i, (k, n, c) in enumerate(PROPOSALS)], "place int, kind string, name string, change string")
    hit = findings.where("flagged").groupBy("kind").agg(F.array_sort(F.collect_set("subject")).alias("subjects")).join(F.broadcast(rules), "kind")
    once = F.row_number().over(W.partitionBy("change", "subjects").orderBy("place"))
    return hit.withColumn("_k", once).where("_k = 1").orderBy("place").limit(most).select("place", "name", "change", "subjects")


def save(ensemble: Ensemble, path: str, version: str, metadata: dict) -> None:
    """The whole ensemble: each fitted part as a Spark ML model beside a JSON row of weights and facts about the fit."""
    parts = [*ensemble.members, *(m for m in (ensemble.total, ensemble.stacker) if m)]
    for m in parts:
        m.model.write().overwrite().save(f"{path}/{version}/{m.name}")
        if m.margin is not None:
            m.margin.write().overwrite().save(f"{path}/{version}/{m.name}-margin")
    c = ensemble.calibrator
    if c.model is not None:
        c.model.write().overwrite().save(f"{path}/{version}/calibrator")
    facts = lambda m: m and {"name": m.name, "features": m.features, "sigma": m.sigma, "margin": m.margin is not None, "chance": m.chance}
    about = {**metadata, "version": version, "p_weights": ensemble.p_weights, "m_weights": ensemble.m_weights, "sigma": ensemble.sigma, "members": list(map(facts, ensemble.members)), "total": facts(ensemble.total), "stacker": facts(ensemble.stacker), "calibrator": {"kind": c.kind, "a": c.a, "b": c.b, "p": c.p}}
    # weights keep their order: it is the order of a stacker's features
    _session().createDataFrame([(version, json.dumps(about, default=str))], "version string, metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/{version}/metadata")


def load(path: str, version: str) -> Ensemble:
    """A saved ensemble, which scores as it did before."""
    about = json.loads(_session().read.schema("version string, metadata string").json(f"{path}/{version}/metadata").first()["metadata"])

    def back(m: dict | None) -> Fitted | None:
        if not m:
            return None
        where = f"{path}/{version}/{m['name']}"
        return Fitted(m["name"], PipelineModel.load(where), tuple(m["features"]), m["sigma"], PipelineModel.load(f"{where}-margin") if m["margin"] else None, m["chance"])

    c = about["calibrator"]
    isotonic = IsotonicRegressionModel.load(f"{path}/{version}/calibrator") if c["kind"] == "isotonic" else None
    return Ensemble(tuple(map(back, about["members"])), about["p_weights"], about["m_weights"], back(about["total"]), back(about["stacker"]), Calibrator(model=isotonic, **c), about["sigma"])


_REGISTERED = "version string, number long, kind string, reason string, parent string"


def register(ensemble: Ensemble, path: str, kind: str, reason: str, metadata: dict | None = None) -> str:
    """Save an ensemble as the next version, which makes it the champion; versions are rows of an append-only table."""
    before = champion(path)
    number = 0 if before is None else before["number"] + 1
    version = f"v1.{number}"
    save(ensemble, path, version, metadata or {})
    row = (version, number, kind, reason, before and before["version"])
    _session().createDataFrame([row], _REGISTERED).coalesce(1).write.mode("append").json(f"{path}/versions")
    return version


def champion(path: str):
    """The row of the newest version, or None where none is registered."""
    try:
        rows = _session().read.schema(_REGISTERED).json(f"{path}/versions")
        return rows.orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def log_predictions(scored: DataFrame, version: str, now: Column, backtest: bool = False) -> DataFrame:
    """Rows for the append-only log: origin, whether the pick is blind, and the cutoff, which is never after the event."""
    cutoff = F.least(now, F.col("kickoff"))
    blind = F.lit(False) if backtest else now < F.col("kickoff")
    return scored.select("game_id", "kickoff", F.lit(version).alias("model_version"), F.lit("backtest" if backtest else "live").alias("origin"), cutoff.alias("cutoff"), blind.alias("is_blind"), "p_home", "pred_margin", "pred_total")
