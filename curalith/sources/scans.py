"""Scans: manifests, group maps, predictions, files, images, JSON and configuration."""

import copy
import hashlib
import json
import os
from collections.abc import Mapping
from pathlib import Path, PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.functions.scalar import class_of_path, difference_hash, portable_path
from curalith.schema import GROUP_MAP_DDL, JOURNAL_DDL, MANIFEST_DDL, PREDICTION_DDL


def load_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with pinned types (identifiers are text, so leading zeros and ``NA`` survive) or Parquet as it is.

    Columns are matched by the file's header; those that the schema doesn't
    name come through as text.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix != ".csv":
        raise ValueError(f"unknown table format {suffix!r}: {path}")
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    known = {f.name: f.dataType for f in spark.createDataFrame([], ddl).schema}
    return raw.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in raw.columns])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, MANIFEST_DDL)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, PREDICTION_DDL)


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, JOURNAL_DDL)


def load_group_map(spark: SparkSession, source: str | Mapping[str, str] | DataFrame) -> DataFrame:
    """A file, a mapping of path to group, or a frame; all text, no path twice."""
    if isinstance(source, DataFrame):
        frame = source
    elif isinstance(source, Mapping):
        frame = spark.createDataFrame([(k, v) for k, v in source.items()], "relative_path string, source_group string")
    else:
        frame = load_table(spark, source, GROUP_MAP_DDL)
    frame = frame.withColumn("relative_path", portable_path("relative_path"))
    if twice := frame.groupBy("relative_path").count().where("count > 1").limit(5).collect():
        raise ValueError(f"paths that the group map has more than once: {[r[0] for r in twice]}")
    return frame


def candidate_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """relative_path, length, modificationTime and content of files below a class folder; the size bound comes before the content is read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    tail = F.regexp_extract("path", r"(?:^|/)" + _quoted(os.path.basename(base)) + "/(.*)$", 1)
    files = files.withColumn("relative_path", tail).where(class_of_path("relative_path").isNotNull())
    return files.where(F.col("length") <= max_bytes) if max_bytes is not None else files


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in name)


def build_manifest(spark: SparkSession, root: str, max_bytes: int = 1 << 26) -> DataFrame:
    """A manifest row for each file: class, surface, hash, size and, from the image reader, its dimensions; unreadable files stay with their error."""
    files = candidate_files(spark, root)
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    joined = files.withColumn("path", plain).join(images.withColumn("path", plain), "path", "left")
    found = class_of_path("relative_path")
    too_large = F.col("length") > max_bytes
    broken = F.coalesce(F.col("height"), F.lit(-1)) < 0
    return joined.select(
        "relative_path",
        found["label"].cast("bigint").alias("label"),
        F.when(found["label"] == 1, "crack").otherwise("non_crack").alias("class_name"),
        found["surface"].alias("surface"),
        F.sha2("content", 256).alias("sha256"),
        F.when(~broken, F.col("width")).cast("bigint").alias("width"),
        F.when(~broken, F.col("height")).cast("bigint").alias("height"),
        F.col("length").alias("file_size_bytes"),
        F.when(too_large | broken, "invalid").otherwise("ok").alias("audit_status"),
        F.when(too_large, "file too large").when(broken, "not a readable image").otherwise("").alias("audit_error"),
    )


def perceptual_hashes(spark: SparkSession, root: str) -> DataFrame:
    """dHash of every readable image: gray means over a 9 x 8 grid of areas, compared with their right neighbours.

    The areas are averaged without the filter that imaging libraries use, so
    hashes compare with one another but not with other programs' hashes.
    """
    @F.pandas_udf("array<array<double>>")
    def grid(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for w, h, c, raw in zip(width, height, channels, data, strict=True):
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c).astype(float)
            gray = pixels[..., 0] if c == 1 else pixels[..., :3] @ [0.114, 0.587, 0.299]
            rows, cols = np.linspace(0, h, 9), np.linspace(0, w, 10)
            mean = lambda a, b, x, y: gray[int(a) : max(int(a) + 1, int(b)), int(x) : max(int(x) + 1, int(y))].mean()
            out.append([[float(mean(rows[i], rows[i + 1], cols[j], cols[j + 1])) for j in range(9)] for i in range(8)])
        return pd.Series(out)

    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).where("image.height > 0")
    cells = images.select(F.col("image.origin").alias("path"), grid("image.width", "image.height", "image.nChannels", "image.data").alias("cells"))
    return cells.select("path", difference_hash("cells").alias("perceptual_hash"))


def load_json_object(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"the root of {path} must be an object")
    return value


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """``over`` laid on ``base``, mapping by mapping; neither is changed."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def load_config(path: str, overrides: Mapping | None = None) -> tuple[dict, str]:
    """(configuration, its hash): JSON, or YAML where PyYAML is installed; ``base`` names one parent file, relative to the child."""

    def read(p: Path, seen: tuple[Path, ...]) -> dict:
        if p in seen:
            raise ValueError(f"configuration inherits from itself: {p}")
        if p.suffix == ".json":
            value = load_json_object(str(p))
        else:
            try:
                import yaml
            except ModuleNotFoundError as e:
                raise ValueError("PyYAML isn't installed; use JSON") from e
            value = yaml.safe_load(p.read_text(encoding="utf-8"))
        parent = value.pop("base", None)
        return deep_merge(read((p.parent / parent).resolve(), (*seen, p)), value) if parent else value

    config = read(Path(path).resolve(), ())
    if overrides:
        config = deep_merge(config, overrides)
    return config, sha256_json(config)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()
