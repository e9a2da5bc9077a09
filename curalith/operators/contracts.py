"""Contracts and gates: selected model and threshold, final evaluation once, external sets.

A gate works on the driver before any scan of test rows is planned.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.scalar import portable_path, safe_path
from curalith.operators import metrics
from curalith.operators.checks import Check, CheckError, captured, enforce, label_values, require_columns
from curalith.schema import EPSILON, RATIOS, SHA256
from curalith.sources import sinks
from curalith.sources.scans import load_json_object, sha256_file, sha256_json


def normalise_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    """The official ratios; other names, values that aren't positive and finite, a sum other than 1, or other shares raise."""
    if list(ratios) != list(RATIOS):
        raise CheckError(f"splits must be {list(RATIOS)}, not {list(ratios)}")
    values = {k: float(v) for k, v in ratios.items()}
    if any(not math.isfinite(v) or v <= 0 for v in values.values()) or abs(sum(values.values()) - 1) > 1e-9:
        raise CheckError(f"ratios must be positive and sum to 1: {values}")
    if any(abs(values[k] - RATIOS[k]) > 1e-9 for k in RATIOS):
        raise CheckError(f"the protocol's ratios are {RATIOS}, not {values}")
    return values


def positive_integer(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise CheckError(f"{name} must be a positive integer, not {value!r}")
    return value


def validate_config(config: Mapping) -> Mapping:
    """The invariants that training relies on: seed, ratios, image size, batch, epochs, threshold."""
    require = lambda ok, what: None if ok else (_ for _ in ()).throw(CheckError(f"configuration: {what}"))
    require(isinstance(config.get("seed"), int) and not isinstance(config.get("seed"), bool), "seed must be an integer")
    normalise_ratios(config.get("split", {}).get("ratios", {}))
    training = config.get("training", {})
    for name in ("batch_size", "head_epochs", "fine_tune_epochs"):
        positive_integer(training.get(name), name)
    rate = training.get("learning_rate")
    require(isinstance(rate, (int, float)) and 0 < rate < 1, "learning_rate must lie in (0, 1)")
    size = config.get("image", {}).get("size")
    require(isinstance(size, (list, tuple)) and len(size) == 2 and all(isinstance(x, int) and x > 0 for x in size), "image.size must be two positive integers")
    threshold = config.get("threshold", 0.5)
    require(isinstance(threshold, (int, float)) and 0 <= threshold <= 1, "threshold must lie in [0, 1]")
    return config


@dataclass(frozen=True)
class Contract:
    """What was selected, bound by hashes: the model's file, the training data, the configuration and the threshold's evidence."""

    run_id: str
    experiment: str
    model_path: str
    model_sha256: str
    manifest_sha256: str
    config_sha256: str
    threshold: float
    threshold_source_split: str
    threshold_evidence_sha256: str

    def check(self) -> Contract:
        for name in ("model_sha256", "manifest_sha256", "config_sha256", "threshold_evidence_sha256"):
            if not re.fullmatch(SHA256.strip("^$"), getattr(self, name)):
                raise CheckError(f"{name} isn't a SHA-256")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", self.run_id):
            raise CheckError(f"run id {self.run_id!r} isn't one path component")
        if not (math.isfinite(self.threshold) and 0 <= self.threshold <= 1):
            raise CheckError(f"threshold {self.threshold!r}")
        if self.threshold_source_split != "validation":
            raise CheckError("a threshold is tuned on validation rows only")
        return self


def lock(contract: Contract, path: str) -> str:
    """Write the contract once, with its own hash; a second lock raises."""
    body = asdict(contract.check())
    sinks.write_json(path, body | {"contract_sha256": sha256_json(body)}, overwrite=False)
    return path


def verify_lock(path: str) -> Contract:
    """The contract, if neither it nor the model's file was changed."""
    body = load_json_object(path)
    digest = body.pop("contract_sha256", None)
    if digest != sha256_json(body):
        raise CheckError("the contract was changed after it was locked")
    contract = Contract(**body).check()
    if sha256_file(contract.model_path) != contract.model_sha256:
        raise CheckError("the model isn't the one that was locked")
    return contract


def tune(validation: DataFrame, source_split: str = "validation") -> dict:
    """The best threshold of validation predictions as a record; other rows are refused."""
    if source_split != "validation":
        raise CheckError("a threshold is tuned on validation rows only")
    if "split" in validation.columns and not validation.where(~F.coalesce(F.lower(F.trim("split")) == "validation", F.lit(False))).isEmpty():
        raise CheckError("the predictions hold rows of another split than validation")
    best = metrics.best_threshold(validation).first().asDict()
    return best | {"source_split": source_split}


def verify_threshold(record: Mapping, validation: DataFrame) -> None:
    """Recompute and compare; counts exactly, ratios within 1e-12."""
    again = tune(validation)
    for k, v in again.items():
        same = record.get(k) == v if not isinstance(v, float) else isinstance(record.get(k), float) and abs(record[k] - v) <= EPSILON
        if not same:
            raise CheckError(f"threshold evidence: {k} is {record.get(k)!r}, recomputed {v!r}")


def final_evaluation(contract_path: str, manifest: DataFrame, score: Callable[[DataFrame], DataFrame], out: str) -> dict:
    """Evaluate the locked model on the test rows, once.

    The lock is verified and a marker claimed before the test rows are
    selected; a second call raises, also after a failure, whose outcome is
    recorded.
    """
    contract = verify_lock(contract_path)
    marker = str(Path(out) / f"{contract.model_sha256}.claimed")
    try:
        sinks.claim(marker, {"run_id": contract.run_id})
    except FileExistsError as e:
        raise CheckError("this model had its final evaluation") from e
    try:
        rows = manifest.where(F.lower(F.trim("split")) == "test")
        if rows.isEmpty():
            raise CheckError("no test rows to evaluate")
        scored = score(rows)
        predictions = metrics.prediction_table(scored, contract.threshold)
        predictions.write.mode("errorifexists").parquet(str(Path(out) / "predictions"))
        written = manifest.sparkSession.read.parquet(str(Path(out) / "predictions"))
        report = metrics.binary_metrics(written, contract.threshold).first().asDict()
        sinks.write_json(str(Path(out) / "metrics.json"), report, overwrite=False)
        sinks.write_json(str(Path(out) / "outcome.json"), {"state": "done"}, overwrite=False)
        return report
    except BaseException as e:
        if not os.path.exists(Path(out) / "outcome.json"):
            sinks.write_json(str(Path(out) / "outcome.json"), {"state": "failed", "error": type(e).__name__})
        raise


def verify_evaluation(out: str, frame: DataFrame, threshold: float) -> None:
    """The stored metrics equal those recomputed from the stored predictions."""
    stored = load_json_object(str(Path(out) / "metrics.json"))
    for k, v in metrics.binary_metrics(frame, threshold).first().asDict().items():
        if isinstance(v, int) and stored.get(k) != v or isinstance(v, float) and not math.isclose(stored.get(k, math.nan), v, rel_tol=1e-9, abs_tol=1e-12):
            raise CheckError(f"stored {k} is {stored.get(k)!r}, recomputed {v!r}")


def external_manifest(frame: DataFrame) -> DataFrame:
    """An external set's rows: self-captured, outside the standard splits, labels 0 or 1, safe paths that differ beyond case."""
    require_columns(frame, ["relative_path", "label", "capture_source"])
    rules = [captured(), label_values(), Check("relative_path_safe", ~safe_path("relative_path"))]
    if "split" in frame.columns:
        rules.append(Check("split_external", F.coalesce(F.lower(F.trim("split")).isin("train", "validation", "test"), F.lit(False))))
    out = enforce(frame, rules).withColumn("relative_path", portable_path("relative_path"))
    if twice := out.groupBy(F.lower("relative_path").alias("p")).count().where("count > 1").limit(5).collect():
        raise CheckError(f"paths that differ in case only: {[r['p'] for r in twice]}")
    return out


def disjoint(external: DataFrame, internal: DataFrame, column: str = "sha256") -> DataFrame:
    """Rows of the external set whose hash the internal set has; empty if they are disjoint."""
    return external.join(internal.select(column).distinct(), column, "left_semi")
