"""Group-wise splits: units from components, seeded multi-start allocation, assignment."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators.checks import CheckError
from curalith.operators.components import components
from curalith.schema import EPSILON, RATIOS

# fixed values
TOTAL_WEIGHT, GROUP_WEIGHT = 0.35, 0.05
SEED_STEP = 1_000_003


@dataclass(frozen=True)
class Units:
    """Allocation units: their ids, groups, counts by stratum (units x strata) and numbers of groups."""

    ids: list[str]
    groups: list[int]
    counts: np.ndarray


def build_units(frame: DataFrame, group: str = "source_group") -> tuple[DataFrame, DataFrame]:
    """(group -> unit, unit x stratum counts); groups that share a hash are one unit."""
    unit_of = components(frame, group, "sha256").withColumnRenamed("component", "unit")
    counts = frame.join(unit_of, group).groupBy("unit", "surface", "label").agg(F.count("*").alias("n"))
    return unit_of, counts


def objective(counts: np.ndarray, groups: np.ndarray, target: np.ndarray, target_groups: np.ndarray) -> float:
    """Mean squared relative error over strata, plus weighted those of totals and of numbers of groups."""
    error = lambda a, b: float(np.mean(((a - b) / np.maximum(b, 1.0)) ** 2))
    return error(counts, target) + TOTAL_WEIGHT * error(counts.sum(axis=1), target.sum(axis=1)) + GROUP_WEIGHT * error(groups, target_groups)


def allocate(units: Units, ratios: Sequence[float], seed: int) -> tuple[float, list[int]]:
    """One start: units by size and rarity, ties shuffled, each to the split where the objective stays least; then moves that lower it."""
    rng = random.Random(seed)
    n, k = len(units.ids), len(ratios)
    whole = units.counts.sum(axis=0).astype(float)
    target = np.outer(ratios, whole)
    groups = np.array(units.groups, float)
    target_groups = np.array(ratios) * groups.sum()
    rarity = (units.counts / np.maximum(whole, 1.0)).max(axis=1)
    noise = [rng.random() for _ in range(n)]
    order = sorted(range(n), key=lambda i: (-int(units.counts[i].sum()), -rarity[i], noise[i]))
    counts, held, where = np.zeros((k, units.counts.shape[1])), np.zeros(k), [-1] * n

    def shift(i: int, s: int, sign: int) -> None:
        counts[s] += sign * units.counts[i]
        held[s] += sign * groups[i]

    for i in order:
        scores = []
        for s in range(k):
            shift(i, s, 1)
            scores.append(objective(counts, held, target, target_groups))
            shift(i, s, -1)
        where[i] = int(np.argmin(scores))
        shift(i, where[i], 1)
    best = objective(counts, held, target, target_groups)
    improved = True
    while improved:
        improved = False
        for i in order:
            home = where[i]
            if where.count(home) == 1:
                continue
            for s in range(k):
                if s == where[i]:
                    continue
                old = where[i]
                shift(i, old, -1)
                shift(i, s, 1)
                now = objective(counts, held, target, target_groups)
                if now < best - EPSILON:
                    best, where[i], improved = now, s, True
                else:
                    shift(i, s, -1)
                    shift(i, old, 1)
    return best, where


def allocate_groups(frame: DataFrame, *, group: str = "source_group", ratios: dict[str, float] | None = None, seed: int = 42, restarts: int = 64) -> DataFrame:
    """(group, unit, split).  Starts run side by side on the executors; the fold over them is in order of start.

    What is sent is one vector for each unit.  Units are what a person curates,
    a few hundred; ``allocate`` is quadratic in them, so more than 5000 raise.
    """
    ratios = ratios or RATIOS
    spark = frame.sparkSession
    unit_of, counts = build_units(frame, group)
    unit_of = unit_of.checkpoint()
    n_units = unit_of.select("unit").distinct().count()
    if n_units < len(ratios):
        raise CheckError(f"{n_units} independent units can't fill {len(ratios)} splits")
    if n_units > 5000:
        raise CheckError(f"{n_units} units are too many for the search; allocate within strata of groups instead")
    local = counts.toPandas()
    strata = sorted({(s, int(x)) for s, x in zip(local["surface"], local["label"], strict=True)})
    spread = local.groupby(["surface", "label"])["unit"].nunique()
    if (spread < len(ratios)).any():
        raise CheckError(f"a stratum has fewer than {len(ratios)} independent units: {spread[spread < len(ratios)].to_dict()}")
    sizes = {r["unit"]: r["n"] for r in unit_of.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    ids = sorted(sizes)
    at = {u: i for i, u in enumerate(ids)}
    matrix = np.zeros((len(ids), len(strata)))
    for u, s, x, n in local[["unit", "surface", "label", "n"]].itertuples(index=False):
        matrix[at[u], strata.index((s, int(x)))] += n
    shared = spark.sparkContext.broadcast(Units(ids, [sizes[u] for u in ids], matrix))
    names = list(ratios)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(r), *allocate(shared.value, [ratios[x] for x in names], seed + SEED_STEP * int(r))) for r in b["id"]]
            yield pd.DataFrame({"restart": [r[0] for r in rows], "score": [r[1] for r in rows], "place": [r[2] for r in rows]})

    starts = spark.range(0, restarts, 1, min(restarts, max(1, spark.sparkContext.defaultParallelism))).mapInPandas(run, "restart bigint, score double, place array<int>")
    best = None
    for r in sorted(starts.collect(), key=lambda r: r["restart"]):
        if best is None or r["score"] < best[0] - EPSILON or abs(r["score"] - best[0]) <= EPSILON and list(r["place"]) < best[1]:
            best = (r["score"], list(r["place"]))
    chosen = spark.createDataFrame([(u, names[s]) for u, s in zip(ids, best[1], strict=True)], "unit string, split string")
    return unit_of.withColumn("unit", F.col("unit").cast("string")).join(F.broadcast(chosen), "unit").select(group, "unit", "split")


def assign(frame: DataFrame, allocation: DataFrame, group: str = "source_group") -> DataFrame:
    """The frame with its groups' splits; a group without one raises."""
    out = frame.drop("split").join(allocation.select(group, "split"), group, "left")
    if missing := out.where("split is null").select(group).distinct().limit(5).collect():
        raise CheckError(f"groups without a split: {[r[0] for r in missing]}")
    return out
