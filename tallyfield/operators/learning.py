"""The learning cycle: a champion, candidates that its findings propose, selection, confirmation, decision."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import checkpointed
from . import folds as V
from . import grading as G
from .models import Config, Policy, fit_ensemble, propose, register, walk_forward

#: One move a cycle, in this order. Of a kind of member, factors of its settings; of the whole configuration, a value.
MOVES = (
    ("logistic", {"C": 1 / 3}),
    ("margin_ridge", {"alpha": 3.0}),
    ("gbm", {"step": 2 / 3, "rounds": 5 / 3}),
    ("logistic", {"C": 3.0}),
    ("margin_ridge", {"alpha": 1 / 3}),
    ("gbm", {"leaf": 2.0, "penalty": 3.0}),
    (None, {"half_life_days": 730.0}),
)
#: What the moves start from where a member's settings don't say.
STARTS = {"C": 0.1, "alpha": 10.0, "step": 0.03, "leaf": 40, "rounds": 300, "penalty": 5.0}


def changed(config: Config, change: dict, subjects: list[str], available: list[str], context: dict[str, str]) -> Config:
    """``config`` after a proposed change; the same one where the change can't apply. ``context`` names the column of a subgroup."""
    columns = sorted({context.get(s, s) for s in subjects} & set(available))
    if change.get("ensemble") == "stack":
        return replace(config, ensemble="stack", stack_context=tuple(sorted({*config.stack_context, *columns}))) if columns else config
    if change.get("capacity"):
        return replace(config, members={k: {**v, "leaves": 31, "leaf": 30} if k.startswith("gbm") else v for k, v in config.members.items()})
    if change.get("drop") == "useless":
        kept = tuple(f for f in config.features if f not in subjects)
        return replace(config, features=kept) if kept and len(config.features) - len(kept) >= 2 else config
    if change.get("drop") == "dead":
        kept = {k: v for k, v in config.members.items() if k not in subjects}
        return replace(config, members=kept) if len(kept) >= 3 else config
    return replace(config, **change)


def moved(config: Config, run: int) -> tuple[str, Config]:
    """The move of this run of the cycle, named after what it changes; the moves take turns."""
    member, by = MOVES[run % len(MOVES)]
    if member is None:
        return "_".join(f"{k}_{v:g}" for k, v in by.items()), replace(config, **by)
    after = lambda v: {s: type(STARTS[s])(round(v.get(s, STARTS[s]) * f, 6)) for s, f in by.items()}
    on = {k: {**v, **after(v)} if k.split("_")[0] == member or k == member else v for k, v in config.members.items()}
    return "_".join([member, *(f"{s}_{'up' if f > 1 else 'down'}" for s, f in by.items())]), replace(config, members=on)


def candidates(config: Config, findings: DataFrame, run: int, policy: Policy, available: list[str], context: dict[str, str]) -> dict[str, Config]:
    """Different configurations by name, at most ``policy.max_candidates``: those that flagged findings propose, a routine look at the
    calibration where none is proposed, and the move of this run. Only the short list of proposals reaches the driver."""
    out: dict[str, Config] = {}

    def add(name: str, new: Config) -> None:
        if new != config and new not in out.values() and len(out) < policy.max_candidates:
            out[name] = new

    rows = propose(findings, policy.max_candidates).orderBy("place").collect()
    calibrated = [r["name"] for r in rows if r["name"].startswith("calibration")]
    if not calibrated:
        routine = "platt" if config.calibration == "none" else "none"
        add(f"calibration_{routine}", replace(config, calibration=routine))
    for r in rows:
        add(r["name"], changed(config, json.loads(r["change"]), list(r["subjects"]), available, context))
        if r["name"] == "stack_residual_features":
            extra = tuple(f for f in r["subjects"] if f in available and f not in config.features)
            add("add_residual_features", replace(config, features=(*config.features, *extra)))
    name, new = moved(config, run)
    add(f"local_{name}", new)
    return out


def decide(gates: dict[str, bool], new_contests: int, policy: Policy) -> str:
    """Structural if a challenger passes all gates, else a refit on enough new contests, else no change."""
    return "structural" if gates and all(gates.values()) else "refit" if new_contests >= policy.min_new else "no change"


def confirm(pairs: DataFrame, policy: Policy, reps: int = 2000) -> dict:
    """Measures and gates of a challenger (p_new) against the champion (p_old) on the same contests."""
    y = F.col("home_win")
    loss = {k: S.log_loss(F.col(f"p_{k}"), y) for k in ("old", "new")}
    sums = pairs.agg(F.count("*").alias("n"), F.avg(loss["old"] - loss["new"]).alias("mean_gain"), *(F.avg(S.brier(F.col(f"p_{k}"), y)).alias(f"brier_{k}") for k in loss)).first().asDict()
    for k in loss:
        sums[f"ece_{k}"] = G.expected_calibration_error(G.calibration_table(pairs, [], p=f"p_{k}"), []).first()["ece"]
    test = V.block_bootstrap(pairs.select(S.iso_week(F.col("kickoff")).alias("week"), (loss["old"] - loss["new"]).alias("gain")), reps).first().asDict()
    gates = {
        "min_sample": sums["n"] >= policy.min_confirm,
        "effect_size": sums["mean_gain"] >= policy.min_gain,
        "significance": test["p_value"] < policy.alpha,
        "brier_not_worse": sums["brier_new"] <= sums["brier_old"],
        "calibration_not_worse": sums["ece_new"] <= sums["ece_old"] + policy.max_ece_worsening,
    }
    return {**sums, **test, "gates": gates}


def learn(
    config: Config, rows: DataFrame, findings: Callable[[DataFrame], DataFrame], new_contests: int, run: int = 0, policy: Policy = Policy(),
    context: dict[str, str] | None = None, registry: str | None = None, reps: int = 2000, known: dict | None = None,
) -> DataFrame:
    """One run record for each model tried: its log loss on the early folds, and for the best candidate that beats the champion there its
    test on the last ``policy.confirm_folds``, which selection hasn't seen. ``findings`` makes (kind, subject, flagged) from the champion's
    out-of-sample predictions. With a ``registry``, a structural change or a refit is fitted on all rows and becomes the champion. A fold
    fits once what candidates have in common; ``known`` keeps it by the start of the fold."""
    spark, known = rows.sparkSession, {} if known is None else known
    walk = lambda c: checkpointed(walk_forward(c, rows, policy, known=known))
    own = walk(config)
    tried = candidates(config, findings(own), run, policy, rows.columns, context or {})
    out = {"champion": own, **{name: walk(c) for name, c in tried.items()}}
    early = F.col("fold") < policy.n_folds - policy.confirm_folds
    long = None
    for name, o in out.items():
        part = o.select(F.lit(name).alias("candidate"), "game_id", "fold", "kickoff", "home_win", "p_home")
        long = part if long is None else long.unionByName(part)
    loss = S.log_loss(F.col("p_home"), F.col("home_win"))
    select = {r["candidate"]: r["ll"] for r in long.where(early).groupBy("candidate").agg(F.avg(loss).alias("ll")).collect()}
    better = [name for name in tried if select[name] < select["champion"]]
    best = min(better, key=lambda name: (select[name], name)) if better else None
    test: dict = {"gates": {}}
    if best is not None:
        old = out["champion"].where(~early).select("game_id", "kickoff", "home_win", F.col("p_home").alias("p_old"))
        test = confirm(old.join(out[best].where(~early).select("game_id", F.col("p_home").alias("p_new")), "game_id"), policy, reps)
    decision = decide(test["gates"], new_contests, policy)
    if registry is not None and decision != "no change":
        chosen = tried[best] if decision == "structural" else config
        register(fit_ensemble(chosen, rows), registry, decision, best or "", {"config": chosen.text(), "rows": rows.count()})
    measures = ("n", "mean_gain", "low", "high", "p_value")
    record = [(name, (config if name == "champion" else tried[name]).text(), select[name], name == best, *(test.get(m) if name == best else None for m in measures), ",".join(k for k, v in test["gates"].items() if not v) if name == best else None, decision) for name in out]
    return spark.createDataFrame(record, "candidate string, config string, selection_ll double, best boolean, n long, mean_gain double, low double, high double, p_value double, failed_gates string, decision string")
