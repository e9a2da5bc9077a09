import dataclasses
import zipfile

import pytest
from pyspark.sql import functions as F

from curalith.operators import contracts, metrics
from curalith.operators.checks import CheckError
from curalith.sources import archives
from curalith.sources.scans import sha256_file


def contract(tmp_path, **over):
    model = tmp_path / "model.bin"
    model.write_bytes(b"weights")
    return dataclasses.replace(contracts.Contract("run-1", "E2", str(model), sha256_file(str(model)), "0" * 64, "1" * 64, 0.45, "validation", "2" * 64), **over)


def test_lock_and_tampering(tmp_path):
    c = contract(tmp_path)
    path = contracts.lock(c, str(tmp_path / "lock.json"))
    assert contracts.verify_lock(path) == c
    with pytest.raises(FileExistsError):
        contracts.lock(c, path)
    (tmp_path / "lock.json").write_text((tmp_path / "lock.json").read_text().replace("0.45", "0.4"))
    with pytest.raises(CheckError, match="changed"):
        contracts.verify_lock(path)
    other = contracts.lock(c, str(tmp_path / "other.json"))
    (tmp_path / "model.bin").write_bytes(b"others")
    with pytest.raises(CheckError, match="model"):
        contracts.verify_lock(other)


@pytest.mark.parametrize("over", [{"run_id": "../x"}, {"threshold": 1.5}, {"threshold_source_split": "test"}, {"config_sha256": "short"}])
def test_bad_contracts(tmp_path, over):
    with pytest.raises(CheckError):
        contracts.lock(contract(tmp_path, **over), str(tmp_path / "lock.json"))


def test_final_evaluation_happens_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0.1, "test"), ("b", 1, 0.9, " Test "), ("c", 1, 0.2, "train")], "relative_path string, y_true int, score double, split string")
    path = contracts.lock(contract(tmp_path), str(tmp_path / "lock.json"))
    report = contracts.final_evaluation(path, rows, lambda df: df, str(tmp_path / "out"))
    assert (report["tp"], report["tn"], report["n"]) == (1, 1, 2)
    contracts.verify_evaluation(str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "out" / "predictions")), 0.45)
    with pytest.raises(CheckError, match="recomputed"):
        contracts.verify_evaluation(str(tmp_path / "out"), rows, 0.45)
    with pytest.raises(CheckError, match="had its final"):
        contracts.final_evaluation(path, rows, lambda df: df, str(tmp_path / "out"))


def test_a_failure_uses_up_the_evaluation(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0.1, "test")], "relative_path string, y_true int, score double, split string")
    path = contracts.lock(contract(tmp_path), str(tmp_path / "lock.json"))

    def broken(df):
        raise RuntimeError("no score")

    with pytest.raises(RuntimeError):
        contracts.final_evaluation(path, rows, broken, str(tmp_path / "out"))
    with pytest.raises(CheckError):
        contracts.final_evaluation(path, rows, lambda df: df, str(tmp_path / "out"))


def test_threshold_evidence(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.45), (1, 0.9)], "y_true int, score double")
    record = contracts.tune(rows)
    contracts.verify_threshold(record, rows)
    with pytest.raises(CheckError, match="f1"):
        contracts.verify_threshold(record | {"f1": 0.5}, rows)
    with pytest.raises(CheckError, match="validation"):
        contracts.tune(rows, "test")


def test_ratios_and_configuration():
    good = {"seed": 42, "split": {"ratios": {"train": 0.7, "validation": 0.15, "test": 0.15}}, "training": {"batch_size": 8, "head_epochs": 1, "fine_tune_epochs": 1, "learning_rate": 1e-3}, "image": {"size": [224, 224]}}
    assert contracts.validate_config(good) is good
    for path, value in (("seed", True), ("image", {"size": [0, 1]}), ("threshold", 2), ("training", {"batch_size": 0})):
        with pytest.raises(CheckError):
            contracts.validate_config(good | {path: value})
    for ratios in ({"train": 0.7, "test": 0.3}, {"train": 0.8, "validation": 0.1, "test": 0.1}, {"train": 0.7, "validation": 0.15, "test": float("nan")}):
        with pytest.raises(CheckError):
            contracts.normalise_ratios(ratios)


@pytest.mark.parametrize("change", [{"capture_source": "web"}, {"label": 2}, {"relative_path": "../x"}, {"relative_path": "B.jpg"}, {"split": "test"}])
def test_external_manifest(spark, change):
    rows = [{"relative_path": "a.jpg", "label": 0, "capture_source": "self_captured", "split": None}, {"relative_path": "b.jpg", "label": 1, "capture_source": "self_captured", "split": "external"}]
    ddl = "relative_path string, label int, capture_source string, split string"
    assert contracts.external_manifest(spark.createDataFrame(rows, ddl)).count() == 2
    with pytest.raises(CheckError):
        contracts.external_manifest(spark.createDataFrame([rows[1], rows[0] | change], ddl))


def test_disjoint(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "sha256 string") for xs in ("abc", "cd"))
    assert [r[0] for r in contracts.disjoint(a, b).collect()] == ["c"]
    assert metrics.class_weights(a.withColumn("label", F.lit(1))).first().weight == 0.5


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return str(path)


def test_extract(tmp_path):
    inner = archive(tmp_path / "inner.zip", [("x/1.txt", "one")])
    outer = archive(tmp_path / "outer.zip", [("d/2.txt", "two"), ("d/in.zip", open(inner, "rb").read())])
    assert archives.extract(outer, str(tmp_path / "out")) == ["d/2.txt", "d/in/x/1.txt"]
    assert (tmp_path / "out/d/in/x/1.txt").read_text() == "one"


@pytest.mark.parametrize("members", [[("../x", "1")], [("/x", "1")], [("C:/x", "1")], [("a", "1"), ("A", "2")], [("zeros", "0" * 10**6)]])
def test_unsafe_archives(tmp_path, members):
    with pytest.raises(archives.UnsafeArchiveError):
        archives.extract(archive(tmp_path / "bad.zip", members), str(tmp_path / "out"))


def test_download_resumes(tmp_path):
    source = tmp_path / "source.bin"
    source.write_bytes(b"some bytes")
    target = str(tmp_path / "got.bin")
    assert archives.download(source.as_uri(), target, archives.md5_file(str(source))) == target
    assert open(target, "rb").read() == b"some bytes"
    with pytest.raises(ValueError, match="MD5"):
        archives.download(source.as_uri(), str(tmp_path / "other.bin"), "0" * 32)
