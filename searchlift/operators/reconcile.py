"""Keyed lifecycle reconciliation: what exists, what a run has seen, and the state after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """active: state of what is seen. regress_from: states that turn into 'regressed' when seen again. keep: states a sighting does not change.
    resolve_from: states that turn into 'resolved' when unseen. types: only these types resolve. counts: occurrence and regression counters.
    if_any: a run that has seen nothing resolves nothing."""

    active: str = "active"
    regress_from: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    resolve_from: tuple[str, ...] = ("active",)
    types: tuple[str, ...] = ()
    counts: bool = False
    if_any: bool = False


FINDINGS = Policy("open", ("resolved", "fixed"), ("dismissed", "regressed"), ("open", "regressed"), counts=True)
OPPORTUNITIES = Policy(types=("low_ctr", "striking_distance", "traffic_decay", "cannibalization"))
LINKS = Policy()
GAPS = Policy(if_any=True)
INSPECTIONS = Policy(types=("indexation_blocked", "not_indexed", "canonical_mismatch"))
CONTENT = Policy("open", resolve_from=())


def reconcile(existing: DataFrame, candidates: DataFrame, policy: Policy, run_at: str, key: str = "key", kind: str = "kind") -> DataFrame:
    """existing: key, kind, status, first_seen, last_seen, resolved_at, occurrences, regressions. candidates: key, kind.

    A full join on the key; the input tables are left as they are and the result is the next state.
    """
    seen_at = F.lit(run_at).cast("timestamp")
    seen = candidates.groupBy(key).agg(F.min(kind).alias("seen_kind")).withColumn("seen", F.lit(True))
    j = existing.join(seen, key, "full")
    old, new = F.col("first_seen").isNotNull(), F.coalesce("seen", F.lit(False))
    regressed = F.col("status").isin(*policy.regress_from) if policy.regress_from else F.lit(False)
    kept = F.col("status").isin(*policy.keep) if policy.keep else F.lit(False)
    gone = F.col("status").isin(*policy.resolve_from) if policy.resolve_from else F.lit(False)
    if policy.if_any and candidates.isEmpty():
        gone = F.lit(False)
    if policy.types:
        gone = gone & F.col(kind).isin(*policy.types)
    status = F.when(~old, policy.active).when(new & regressed, "regressed").when(new & kept, F.col("status")).when(new, policy.active).when(gone, "resolved").otherwise(F.col("status"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        key, F.coalesce(kind, "seen_kind").alias(kind), status.alias("status"), F.coalesce("first_seen", seen_at).alias("first_seen"),
        F.when(new, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~new & gone, seen_at).when(new & ~kept, F.lit(None)).otherwise(F.col("resolved_at")).alias("resolved_at"),
        (n("occurrences") + (new & F.lit(policy.counts)).cast("int")).alias("occurrences"), (n("regressions") + (old & new & regressed & F.lit(policy.counts)).cast("int")).alias("regressions"),
    )


STATE = "key string, kind string, status string, first_seen timestamp, last_seen timestamp, resolved_at timestamp, occurrences int, regressions int"


def runs(candidates: list[DataFrame], policy: Policy, days: list[str]) -> DataFrame:
    """The state after several runs, from nothing."""
    state = candidates[0].sparkSession.createDataFrame([], STATE)
    for seen, day in zip(candidates, days, strict=True):
        state = reconcile(state, seen, policy, day)
    return state
