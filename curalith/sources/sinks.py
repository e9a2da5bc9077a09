"""Sinks: atomic and write-once files, split folders, bundles and markers."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.operators.checks import CheckError, null_cells
from curalith.sources.scans import sha256_file


def json_ready(value: object) -> object:
    """Plain JSON types; NumPy scalars by item(), non-finite numbers refused."""
    if isinstance(value, Mapping):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("JSON has no such number")
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_json(path: str, payload: object, overwrite: bool = True) -> None:
    """Written beside and renamed, so a reader sees the old file or the new one; without ``overwrite`` an existing file raises."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(json_ready(payload), indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    try:
        if overwrite:
            os.replace(part, target)
        else:
            os.link(part, target)
    finally:
        part.unlink(missing_ok=True)


def write_json_once_or_verify(path: str, payload: object) -> None:
    if Path(path).exists():
        if json.loads(Path(path).read_text(encoding="utf-8")) != json_ready(payload):
            raise CheckError(f"{path} exists with other content")
    else:
        write_json(path, payload, overwrite=False)


def write_csv_immutable(frame: DataFrame, path: str, allow_nulls: bool = False) -> None:
    """A CSV folder that must not exist; null cells raise before anything is written."""
    if not allow_nulls and (bad := [r["column_name"] for r in null_cells(frame).where("n_null > 0").collect()]):
        raise CheckError(f"null cells in {bad}")
    frame.write.mode("errorifexists").option("header", True).csv(path)


def write_once_or_verify(frame: DataFrame, path: str) -> None:
    """Write Parquet, or prove that what is there is the same bag of rows."""
    spark = frame.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        frame.write.mode("errorifexists").parquet(path)
        return
    old = spark.read.parquet(path)
    if sorted(old.columns) != sorted(frame.columns):
        raise CheckError(f"{path} has other columns")
    old = old.select(frame.columns)
    if not old.exceptAll(frame).isEmpty() or not frame.exceptAll(old).isEmpty():
        raise CheckError(f"{path} exists with other rows")


def write_by_split(frame: DataFrame, path: str, column: str = "split") -> None:
    frame.write.mode("errorifexists").partitionBy(column).parquet(path)


def markdown_table(frame: DataFrame) -> str:
    """A report's table; numbers with ten significant digits."""
    render = lambda v: "" if v is None else format(v, ".10g") if isinstance(v, float) else str(v).replace("|", "\\|")
    head = "| " + " | ".join(frame.columns) + " |\n|" + "---|" * len(frame.columns) + "\n"
    return head + "".join("| " + " | ".join(render(v) for v in row) + " |\n" for row in frame.collect())


def group_map_template(manifest: DataFrame, path: str) -> None:
    out = manifest.select("relative_path", F.lit("").alias("source_group"), F.lit("false").alias("verified"), F.lit("").alias("review_notes"), "sha256")
    out.orderBy("relative_path").write.mode("errorifexists").option("header", True).csv(path)


def claim(path: str, payload: object) -> None:
    """A marker that one process only can make; it is on disk before this returns."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(json_ready(payload), f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())


MARKER = "complete.json"


def inventory(folder: str) -> dict[str, str]:
    """Relative path -> SHA-256 of every file but the marker and checksums that Hadoop's writer leaves."""
    base = Path(folder)
    return {p.relative_to(base).as_posix(): sha256_file(str(p)) for p in sorted(base.rglob("*")) if p.is_file() and p.name != MARKER and not p.name.endswith(".crc")}


def create_bundle(target: str, write: Callable[[str], None], facts: Mapping | None = None) -> dict:
    """Create-once: ``write`` fills a staging folder, its inventory goes into a marker written last, and a rename publishes it."""
    final = Path(target)
    if final.exists():
        raise FileExistsError(target)
    final.parent.mkdir(parents=True, exist_ok=True)
    staging = final.with_name(f".{final.name}.{uuid.uuid4().hex}")
    staging.mkdir()
    try:
        write(str(staging))
        marker = {"files": inventory(str(staging)), "facts": dict(facts or {})}
        write_json(str(staging / MARKER), marker, overwrite=False)
        verify_bundle(str(staging))
        os.rename(staging, final)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return marker


def verify_bundle(folder: str) -> dict:
    """The marker, if exactly its files are there with their hashes."""
    marker = json.loads((Path(folder) / MARKER).read_text(encoding="utf-8"))
    found = inventory(folder)
    if found != marker["files"]:
        odd = sorted(set(found.items()) ^ set(marker["files"].items()))
        raise CheckError(f"{folder} was changed: {sorted({k for k, _ in odd})[:5]}")
    return marker


def curation_bundle(spark: SparkSession, manifest: DataFrame, target: str) -> dict:
    """Curated rows, conflict rows and counts as a bundle, after the proof that they partition the manifest."""
    from curalith.operators import curation

    kept, bad = curation.curated(manifest), curation.conflict_rows(manifest)
    proof = curation.partition_check(manifest, kept, bad).first().asDict()
    if any(proof.values()):
        raise CheckError(f"curation isn't a partition: {proof}")

    def write(folder: str) -> None:
        kept.write.parquet(f"{folder}/curated")
        bad.write.parquet(f"{folder}/conflict_rows")

    return create_bundle(target, write, curation.curation_counts(manifest).first().asDict())


def split_bundle(frame: DataFrame, target: str) -> dict:
    """A frame with splits, one folder for each, with its audit and canonical hash as facts."""
    from curalith.operators import audit, fingerprint

    if shared := audit.overlaps(frame).where("n_shared > 0").collect():
        raise CheckError(f"splits overlap: {[(r['column_name'], r['pair'], r['n_shared']) for r in shared]}")
    facts = {
        "counts": [r.asDict() for r in audit.counts(frame).orderBy("split").collect()],
        "violations": [r.asDict() for r in audit.violations(frame).orderBy("kind", "split", "key").collect()],
        "canonical_sha256": fingerprint.canonical(frame).first()["fingerprint"],
    }
    return create_bundle(target, lambda folder: write_by_split(frame, f"{folder}/splits"), facts)
