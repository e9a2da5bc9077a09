"""Constraint checks: predicates over rows, counted in one aggregate, raised on the driver.

A check that is an expression in an unused column would be pruned, so every
check is a count here; the examples of an error are read once it is raised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.functions.scalar import blank, class_of_path, finite, safe_path, strict_label, truthy
from curalith.schema import OUTCOMES, SHA256, SPLITS, SURFACES


class CheckError(ValueError):
    """A table breaks a rule; the message names it, the count and some keys."""


@dataclass(frozen=True)
class Check:
    """``violated`` is true for a row that breaks the rule; null counts as broken."""

    name: str
    violated: Column


def require_columns(frame: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in frame.columns]:
        raise CheckError(f"columns missing: {', '.join(missing)}")


def violations(frame: DataFrame, checks: Sequence[Check], key: str = "relative_path") -> DataFrame:
    """(check_name, n_violations, the least key that violates it) of each check, all in one pass."""
    hit = lambda c: F.coalesce(c.violated, F.lit(True))
    wide = frame.agg(*[F.count_if(hit(c)).alias(f"n{i}") for i, c in enumerate(checks)], *[F.min(F.when(hit(c), F.col(key).cast("string"))).alias(f"e{i}") for i, c in enumerate(checks)])
    rows = [F.struct(F.lit(c.name).alias("check_name"), F.col(f"n{i}").alias("n_violations"), F.col(f"e{i}").alias("example")) for i, c in enumerate(checks)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def enforce(frame: DataFrame, checks: Sequence[Check], key: str = "relative_path") -> DataFrame:
    """The frame itself; raises CheckError if a check is violated or the table is empty."""
    broken = [r for r in violations(frame, checks, key).collect() if r["n_violations"]]
    if frame.isEmpty():
        raise CheckError("the table is empty")
    if broken:
        parts = []
        for r in broken:
            check = next(c for c in checks if c.name == r["check_name"])
            some = [x[0] for x in frame.where(F.coalesce(check.violated, F.lit(True))).select(F.col(key).cast("string")).orderBy(F.col(key)).limit(5).collect()]
            parts.append(f"{r['check_name']}: {r['n_violations']} rows, such as {some}")
        raise CheckError("; ".join(parts))
    return frame


def unique(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_blank(column: str) -> Check:
    return Check(f"{column}_blank", blank(column))


def sha_shape(column: str = "sha256") -> Check:
    return Check(f"{column}_shape", ~F.col(column).rlike(SHA256))


def label_values(column: str = "label") -> Check:
    return Check(f"{column}_values", strict_label(column).isNull())


def surface_values(column: str = "surface", values: Sequence[str] = tuple(SURFACES)) -> Check:
    return Check(f"{column}_values", ~F.col(column).isin(list(values)))


def split_values(column: str = "split") -> Check:
    return Check(f"{column}_values", ~F.lower(F.trim(column)).isin(SPLITS))


def verified(column: str = "source_group_verified") -> Check:
    return Check(f"{column}_true", ~truthy(column))


def path_safe(column: str = "relative_path") -> Check:
    return Check(f"{column}_safe", ~safe_path(column))


def audit_ok(column: str = "audit_status", exact: bool = True) -> Check:
    value = F.col(column) if exact else F.lower(F.trim(column))
    return Check(f"{column}_ok", value != "ok")


def path_agrees(surface: str = "surface", label: str = "label", path: str = "relative_path") -> Check:
    found = class_of_path(path)
    return Check("path_agrees", ~(found["surface"].eqNullSafe(F.col(surface)) & found["label"].eqNullSafe(F.col(label).cast("int"))))


def score_range(column: str = "score") -> Check:
    return Check(f"{column}_range", ~(finite(column) & F.col(column).between(0.0, 1.0)))


def outcome_consistent() -> Check:
    from curalith.functions.scalar import at_threshold, outcome

    again = at_threshold("score", F.col("threshold"))
    return Check("outcome_consistent", ~((F.col("y_pred") == again) & (F.col("outcome") == outcome("y_true", again)) & F.col("outcome").isin(OUTCOMES)))


def split_blank(column: str = "split") -> Check:
    return Check(f"{column}_not_blank", ~blank(column))


def captured(column: str = "capture_source") -> Check:
    return Check(f"{column}_self", F.col(column) != "self_captured")


def lenient_label(column: str = "label") -> Check:
    """0 or 1 in any form that reads as a number; one class alone is fine."""
    return Check(f"{column}_lenient", ~F.col(column).cast("string").try_cast("double").isin(0.0, 1.0))


def in_range(column: str, low: float, high: float) -> Check:
    return Check(f"{column}_range", ~(finite(column) & F.col(column).between(low, high)))


def history_checks(columns: Sequence[str]) -> list[Check]:
    """A journal's losses are finite and not negative; accuracies come in pairs and lie in [0, 1]."""
    if ("accuracy" in columns) != ("val_accuracy" in columns):
        raise CheckError("accuracy and val_accuracy come together or not at all")
    losses = [in_range(c, 0.0, 1.7976931348623157e308) for c in ("loss", "val_loss") if c in columns]
    return losses + [in_range(c, 0.0, 1.0) for c in ("accuracy", "val_accuracy") if c in columns]


def external_checks() -> list[Check]:
    """Rows of an external set: self-captured, a safe path, a label, and outside the standard splits."""
    outside = Check("split_external", F.coalesce(F.lower(F.trim("split")).isin(SPLITS), F.lit(False)))
    return [captured(), label_values(), path_safe(), outside]


def manifest_checks() -> list[Check]:
    return [not_blank("relative_path"), not_blank("source_group"), not_blank("surface"), sha_shape(), label_values(), surface_values(), verified(), path_safe(), audit_ok()]


def expected_counts(frame: DataFrame, rows: int, groups: int, group: str = "source_group") -> None:
    found = frame.agg(F.count("*").alias("n"), F.count_distinct(group).alias("g")).first()
    if (found["n"], found["g"]) != (rows, groups):
        raise CheckError(f"expected {rows} rows in {groups} groups, found {found['n']} in {found['g']}")


def null_cells(frame: DataFrame) -> DataFrame:
    """(column_name, n_null) of every column, one pass."""
    wide = frame.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(frame.columns)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(frame.columns)])).alias("r")).select("r.*")
