"""Literal cases of the operators' semantics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curalith.functions import scalar
from curalith.operators import audit, checks, components, curation, fingerprint, frames, history, latency, metrics, model, profile, reconcile, split
from curalith.plans import inventory, register  # noqa: F401
from curalith.sources import scans, sinks


def preds(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, y_true int, score double")


def scored(spark, y, s):
    return preds(spark, [(f"{i}", a, b) for i, (a, b) in enumerate(zip(y, s, strict=True))])


def test_metrics_of_four_rows(spark):
    m = metrics.binary_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.8, 0.9, 0.2]), 0.5).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 1, 1)
    assert m.accuracy == m.precision_1 == m.recall_1 == m.f1_1 == 0.5


def test_metrics_with_one_class_and_without_rows(spark):
    m = metrics.binary_metrics(scored(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.f1_1) == (2, 0, 0, 0, 0.0)
    assert metrics.binary_metrics(preds(spark, []), 0.5).first().accuracy == 0.0


@pytest.mark.parametrize(("y", "s", "best"), [([0, 0, 1, 1], [0.1, 0.4, 0.45, 0.9], 0.45), ([0, 1], [0.1, 0.9], 0.5)])
def test_best_threshold(spark, y, s, best):
    b = metrics.best_threshold(scored(spark, y, s)).first()
    assert (b.threshold, b.f1) == (best, 1.0)


def test_curve_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(str(i), rng.randint(0, 1), rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, rng.random()])) for i in range(400)] + [("n", None, 0.5), ("o", 1, 1.5), ("x", 1, None), ("nan", 1, float("nan"))]
    valid = [(y, s) for _, y, s in rows if y is not None and s is not None and 0 <= s <= 1]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_curve(preds(spark, rows)).collect()}
    assert set(got) == {s for _, s in valid} | {0.0, 0.5, 1.0}
    for t, row in got.items():
        tp, fp = sum(y == 1 and s >= t for y, s in valid), sum(y == 0 and s >= t for y, s in valid)
        assert row == (tp, fp, sum(y for y, _ in valid) - tp, sum(1 - y for y, _ in valid) - fp)


def test_examples_are_the_same_in_any_order(spark):
    rows = [(p, y, s) for p, y, s in zip(["z/tp", "a/tp", "z/tn", "a/tn", "z/fp", "a/fp", "z/fn", "a/fn"], [1, 1, 0, 0, 0, 0, 1, 1], [0.9, 0.9, 0.1, 0.1, 0.8, 0.8, 0.2, 0.2], strict=True)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r.outcome: r.relative_path for r in metrics.examples(preds(spark, rows), 0.5).collect()}
        assert got == {"TP": "a/tp", "TN": "a/tn", "FP": "a/fp", "FN": "a/fn"}
    assert {r.outcome: r.relative_path for r in metrics.examples(preds(spark, rows[:0]), 0.5).collect()} == dict.fromkeys(["TP", "TN", "FP", "FN"])


def test_threshold_is_inclusive(spark):
    got = {r.relative_path: (r.y_pred, r.outcome) for r in metrics.prediction_table(preds(spark, [("a", 0, 0.5), ("b", 1, 0.499)]), 0.5).collect()}
    assert got == {"a": (1, "FP"), "b": (0, "FN")}


def manifest(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, label bigint, surface string, source_group string, sha256 string, file_size_bytes bigint, split string")


CURATION = [
    ("D/CD/7039-112.jpg", 1, "D", "7039", "conflict-a"), ("D/UD/7039-112_2.jpg", 0, "D", "7039", "conflict-a"), ("W/UW/7074-105_2.jpg", 0, "W", "7074", "conflict-b"), ("W/CW/7074-105.jpg", 1, "W", "7074", "conflict-b"),
    ("P/UP/001-1.jpg", 0, "P", "001", "kept"), ("P/UP/002-1.jpg", 0, "P", "002", "kept"), ("P/CP/003-1.jpg", 1, "P", "003", "own"),
]


def test_curation_keeps_duplicates_and_drops_conflicts(spark):
    m = manifest(spark, [(*r, 1, "") for r in CURATION])
    assert {r.relative_path for r in curation.curated(m).collect()} == {r[0] for r in CURATION[4:]}
    assert {(r.exact_sha256, r.conflicting_labels, r.hash_group_row_count) for r in curation.conflict_rows(m).collect()} == {("conflict-a", "0|1", 2), ("conflict-b", "0|1", 2)}
    c = curation.curation_counts(m).first()
    assert (c.parent_rows, c.excluded_rows, c.curated_rows, c.conflicting_hashes) == (7, 4, 3, 2)
    assert set(curation.partition_check(m, curation.curated(m), curation.conflict_rows(m)).first()) == {0}
    assert curation.partition_check(m, curation.curated(m), curation.curated(m)).first().overlap == 3


def synthetic(spark, per=12):
    rows = [(f"{s}/{y}/{i}", y, s, f"{s}{y}{i:02d}", f"{s}-{y}-{i}", 1, "") for s in "DPW" for y in (0, 1) for i in range(per)]
    return manifest(spark, rows)


def test_split_is_deterministic_disjoint_and_balanced(spark):
    m = synthetic(spark)
    a = split.assign(m, split.allocate_groups(m, restarts=4))
    b = split.assign(m, split.allocate_groups(m.orderBy(F.rand(3)), restarts=4))
    assert sorted(a.select("relative_path", "split").collect()) == sorted(b.select("relative_path", "split").collect())
    assert audit.overlaps(a).where("n_shared > 0").isEmpty()
    assert all(r.deviation < 0.05 for r in audit.counts(a).collect())
    assert audit.strata(a).where("n = 0").isEmpty()


def test_groups_that_share_a_hash_stay_together(spark):
    m = synthetic(spark).withColumn("sha256", F.when(F.col("source_group").isin("D000", "D001", "D002"), "same").otherwise(F.col("sha256")))
    got = {r.source_group: r.split for r in split.allocate_groups(m, restarts=2).collect()}
    assert got["D000"] == got["D001"] == got["D002"]


def test_split_needs_three_units_in_a_stratum(spark):
    with pytest.raises(checks.CheckError, match="independent units"):
        split.allocate_groups(synthetic(spark, 2), restarts=1)


def test_components_of_a_long_chain(spark):
    rows = [(i, f"h{i // 2}") for i in range(40)] + [(i, f"k{(i + 1) // 2}") for i in range(40)] + [(100, None), (101, "")]
    got = {r.g: r.component for r in components.components(spark.createDataFrame(rows, "g int, v string"), "g", "v").collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100, 101: 101}


def test_checks_count_and_raise(spark):
    m = manifest(spark, [("a", 0, "D", "g", "0" * 64, 1, "train"), ("../b", 2, "X", " ", "short", 1, "none"), (None, None, None, None, None, None, None)])
    got = {r.check_name: r.n_violations for r in checks.violations(m, [checks.path_safe(), checks.label_values(), checks.surface_values(), checks.not_blank("source_group"), checks.sha_shape(), checks.split_values()]).collect()}
    assert set(got.values()) == {2}
    with pytest.raises(checks.CheckError, match="sha256_shape"):
        checks.enforce(m, [checks.sha_shape()])
    with pytest.raises(checks.CheckError, match="empty"):
        checks.enforce(m.limit(0), [checks.sha_shape()])
    with pytest.raises(checks.CheckError, match="missing"):
        checks.require_columns(m, ["nope"])
    assert {r.column_name: r.n_null for r in checks.null_cells(m).collect()}["label"] == 1


@pytest.mark.parametrize(("raw", "value"), [("0", 0), (" 1 ", 1), ("1.0", 1), ("0.5", None), ("true", None), ("", None), (None, None), ("2", None)])
def test_strict_label(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(scalar.strict_label("x")).first()[0] == value


@pytest.mark.parametrize(("path", "safe", "kind"), [("D/CD/1.jpg", True, ("D", 1)), (".\\W\\UW\\2.jpg", True, ("W", 0)), ("../escape.jpg", False, None), ("C:/escape.jpg", False, None), ("", False, None), ("/P/CP/1", False, ("P", 1)), ("CD/UD/1", True, None)])
def test_paths(spark, path, safe, kind):
    r = spark.createDataFrame([(path,)], "p string").select(scalar.safe_path("p").alias("s"), scalar.class_of_path("p").alias("c")).first()
    assert r.s == safe and (tuple(r.c) if r.c else None) == kind


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalar.hex64(F.lit(255))) == "00000000000000ff"
    assert get(scalar.experiment_rank(F.lit("E12"))) == 12 and get(scalar.experiment_rank(F.lit("x3"))) == 999
    assert get(scalar.safe_component(F.lit(" -a b/c. "))) == "a-b-c"
    assert get(scalar.close(F.lit(1.0), F.lit(1.0 + 1e-10))) and not get(scalar.finite(F.lit(float("nan"))))
    assert get(scalar.clip(F.lit(2.0), 0.0, 1.0)) == 1.0 and get(scalar.truthy(F.lit(" Yes "))) and not get(scalar.truthy(F.lit(None).cast("string")))
    rows = F.array(*[F.array(*[F.lit(float(j)) for j in range(9)]) for _ in range(8)])
    assert get(scalar.difference_hash(rows)) == "f" * 16


def test_history(spark):
    h = spark.createDataFrame([(0, e, v, r) for e, v, r in zip([2, 3, 4, 5], [0.5, 0.4, 0.42, 0.43], [1e-3, 1e-3, 2e-4, 2e-4], strict=True)], "run int, epoch int, val_loss double, learning_rate double")
    b = history.best_epochs(h, "run").first()
    assert (b.best_loss, b.best_epoch, b.early_wait) == (0.4, 3, 2)
    assert history.learning_rate_changes(h, "run").first().reduce_wait == 1
    both = history.concatenated(spark.createDataFrame([(0, 0.9), (1, 0.6)], "epoch int, loss double"), spark.createDataFrame([(0, 0.5, 1.0), (1, 0.4, 1.0)], "epoch int, loss double, learning_rate double"))
    got = history.global_epochs(both.withColumn("run", F.lit(1)), "run", ["head", "fine_tune"]).orderBy("global_epoch").collect()
    assert [r.phase_epoch for r in got] == [1, 2, 1, 2] and [r.global_epoch for r in got] == [1, 2, 3, 4]
    twice = spark.createDataFrame([(0, 0.8), (1, 0.7), (1, 0.6)], "epoch int, loss double")
    assert history.conflicting_epochs(twice, ["epoch"], ["loss"]).first().epoch == 1


def test_latency_interpolates(spark):
    ticks = iter([0.0, 0.1, 1.0, 1.2, 2.0, 2.3])
    raw, summary = latency.benchmark(spark, lambda: None, warmup=0, measured=3, clock=lambda: next(ticks))
    s = summary.first()
    assert [round(x) for x in raw] == [100, 200, 300]
    assert (round(s.mean_ms), round(s.p50_ms), round(s.p95_ms), s.target_met) == (200, 200, 290, True)
    with pytest.raises(ValueError, match="measured"):
        latency.benchmark(spark, lambda: None, measured=0)


def test_fingerprint_ignores_order(spark):
    m = manifest(spark, [(*r, 1, "") for r in CURATION])
    a = fingerprint.canonical(m).first()
    assert a == fingerprint.canonical(m.orderBy(F.rand(1)).select(sorted(m.columns, reverse=True)).repartition(3)).first()
    assert a.fingerprint != fingerprint.canonical(m.limit(6)).first().fingerprint
    assert fingerprint.canonical(m, parts=4).first() == fingerprint.canonical(m.repartition(2), parts=4).first()


def test_manifest_csv_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("P/UP/001-1.jpg", "001", "0" * 63 + "1", "0000000000000001", "NA", 3)], "relative_path string, source_group string, sha256 string, perceptual_hash string, source_mode string, width bigint")
    m.write.option("header", True).csv(str(tmp_path / "m.csv"))
    back = scans.load_manifest(spark, str(tmp_path / "m.csv"))
    assert back.collect() == m.collect()
    assert fingerprint.canonical(back).first() == fingerprint.canonical(m).first()
    with pytest.raises(ValueError, match="format"):
        scans.load_manifest(spark, "m.xlsx")


def test_group_map(spark):
    m = manifest(spark, [(*r, 1, "") for r in CURATION])
    full = scans.load_group_map(spark, {r[0]: "g" for r in CURATION})
    assert reconcile.with_groups(m, full).where("source_group = 'g'").count() == 7
    with pytest.raises(ValueError, match="cover"):
        reconcile.with_groups(m, full.limit(6))
    with pytest.raises(ValueError, match="more than once"):
        scans.load_group_map(spark, full.unionByName(full))


def test_files(spark, tmp_path):
    for p, data in (("D/CD/1.jpg", b"first-image"), ("W/UW/2.jpg", b"second-image"), ("notes/3.txt", b"x")):
        (tmp_path / "set" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / p).write_bytes(data)
    files = scans.candidate_files(spark, str(tmp_path / "set"))
    assert {r.relative_path for r in files.collect()} == {"D/CD/1.jpg", "W/UW/2.jpg"}
    good = files.select("relative_path", F.sha2("content", 256).alias("sha256"))
    assert fingerprint.verify_files(files, good).first().asDict() == {"n_ok": 2, "n_different": 0, "n_missing": 0, "n_unknown": 0, "n_bytes": 23}
    assert fingerprint.verify_files(files, good.withColumn("sha256", F.lit("x"))).first().n_different == 2
    built = {r.relative_path: (r.label, r.surface, r.audit_status) for r in scans.build_manifest(spark, str(tmp_path / "set")).collect()}
    assert built == {"D/CD/1.jpg": (1, "D", "invalid"), "W/UW/2.jpg": (0, "W", "invalid")}


def test_image(spark, tmp_path):
    import struct
    import zlib

    def png(path, width, height, value):
        raw = b"".join(b"\0" + bytes(v for x in range(width) for v in value(x, y)) for y in range(height))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "s/D/CD/up.png", 64, 64, lambda x, y: (x * 3,) * 3)
    png(tmp_path / "s/D/UD/down.png", 64, 64, lambda x, y: (255 - x * 3,) * 3)
    hashes = {r.path.rsplit("/", 1)[1]: r.perceptual_hash for r in scans.perceptual_hashes(spark, str(tmp_path / "s")).collect()}
    assert hashes == {"up.png": "f" * 16, "down.png": "0" * 16}
    built = {r.relative_path: (r.width, r.height, r.audit_status) for r in scans.build_manifest(spark, str(tmp_path / "s")).collect()}
    assert built == {"D/CD/up.png": (64, 64, "ok"), "D/UD/down.png": (64, 64, "ok")}


def test_json_and_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"seed": 42, "data": {"a": 1, "b": 2}}))
    (tmp_path / "child.json").write_text(json.dumps({"base": "base.json", "data": {"b": 3}}))
    config, digest = scans.load_config(str(tmp_path / "child.json"), {"seed": 7})
    assert config == {"seed": 7, "data": {"a": 1, "b": 3}}
    assert digest == scans.sha256_json({"data": {"b": 3, "a": 1}, "seed": 7})
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError, match="object"):
        scans.load_json_object(str(tmp_path / "list.json"))
    target = tmp_path / "out" / "x.json"
    sinks.write_json(str(target), {"a": float(1)}, overwrite=False)
    with pytest.raises(FileExistsError):
        sinks.write_json(str(target), {"a": 2}, overwrite=False)
    sinks.write_json_once_or_verify(str(target), {"a": 1.0})
    with pytest.raises(checks.CheckError):
        sinks.write_json_once_or_verify(str(target), {"a": 2})
    sinks.claim(str(tmp_path / "marker"), {})
    with pytest.raises(FileExistsError):
        sinks.claim(str(tmp_path / "marker"), {})


def test_bundles(spark, tmp_path):
    m = manifest(spark, [(*r, 1, "") for r in CURATION])
    marker = sinks.curation_bundle(spark, m, str(tmp_path / "bundle"))
    assert marker["facts"]["excluded_rows"] == 4
    assert sinks.verify_bundle(str(tmp_path / "bundle")) == marker
    with pytest.raises(FileExistsError):
        sinks.curation_bundle(spark, m, str(tmp_path / "bundle"))
    victim = next(p for p in (tmp_path / "bundle").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(checks.CheckError, match="changed"):
        sinks.verify_bundle(str(tmp_path / "bundle"))
    s = synthetic(spark)
    done = split.assign(s, split.allocate_groups(s, restarts=1))
    assert sinks.split_bundle(done, str(tmp_path / "split"))["facts"]["canonical_sha256"] == fingerprint.canonical(done).first().fingerprint
    with pytest.raises(checks.CheckError, match="overlap"):
        sinks.split_bundle(done.withColumn("source_group", F.lit("one")), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_table_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    with pytest.raises(checks.CheckError, match="null"):
        sinks.write_csv_immutable(t, str(tmp_path / "c"))
    sinks.write_once_or_verify(t, str(tmp_path / "p"))
    sinks.write_once_or_verify(t.orderBy(F.desc("k")), str(tmp_path / "p"))
    with pytest.raises(checks.CheckError, match="rows"):
        sinks.write_once_or_verify(t.distinct(), str(tmp_path / "p"))
    assert sinks.markdown_table(spark.createDataFrame([(0.1, "a|b")], "x double, y string")).splitlines()[2] == "| 0.1 | a\\|b |"
    assert profile.sample(t, 2, 1, "v").count() == 2 and profile.shuffled(t, 1, 0, "v").count() == 3


def test_model(spark):
    rng = random.Random(1)
    rows = [(str(i), i % 2, [float(i % 2) + rng.gauss(0, 0.1), rng.random()], "train") for i in range(200)]
    data = spark.createDataFrame(rows, "relative_path string, y_true int, features array<double>, split string")
    fitted = model.train(data)
    assert metrics.binary_metrics(model.score(fitted, data), 0.5).first().accuracy > 0.95
    losses = [r.loss for r in model.history(fitted).orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    with pytest.raises(ValueError, match="train split"):
        model.train(data.withColumn("split", F.lit("test")))


def test_first_of_each_keeps_keys_without_order(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 3, 6), (2, None, 7), (None, 4, 8)], "k int, o int, v int")
    assert sorted(frames.first_of_each(rows, "k", "o").collect(), key=str) == sorted([(1, None, 5), (2, 3, 6), (None, 4, 8)], key=str)


def test_first_of_each_takes_the_first_of_tied_rows(spark, tmp_path):
    rows = [(i % 50, i // 200, 1, float(i)) for i in range(1000)]
    for part in (0, 1):
        data = spark.createDataFrame(rows[part * 500 : part * 500 + 500], "l_partkey bigint, l_orderkey bigint, l_linenumber int, l_quantity double")
        data.coalesce(1).sortWithinPartitions(F.col("l_quantity").desc()).write.parquet(str(tmp_path / f"part{part}"))
    (tmp_path / "lineitem.parquet").mkdir()
    for part in (0, 1):
        next((tmp_path / f"part{part}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{part}.parquet")
    found = {r.l_partkey: (r.place, r.l_quantity) for r in register.QUERIES["first_of_each"](spark, str(tmp_path)).collect()}
    assert found == {k: (1, 150.0 + k) for k in range(50)}
