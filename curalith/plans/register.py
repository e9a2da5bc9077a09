"""Query register: name -> (spark, sf_dir) -> DataFrame, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.functions import scalar
from curalith.operators import audit, checks, components, curation, fingerprint, history, metrics, model, profile, reconcile, split
from curalith.plans.adapters import HISTORY, MANIFEST, PREDICTIONS, TIED, allocation, predictions, table, tied_predictions
from curalith.plans.adapters import history as histories
from curalith.plans.adapters import manifest as manifests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Metrics

_COUNTS = "count(*) filter (y_true = 0 and p = 0) as tn, count(*) filter (y_true = 0 and p = 1) as fp, count(*) filter (y_true = 1 and p = 0) as fn, count(*) filter (y_true = 1 and p = 1) as tp"


def _ratio(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0.0::double else ({a})::double / ({b})::double end"


_CLASSES = f"""{_ratio('tp + tn', 'tn + fp + fn + tp')} as accuracy,
  {_ratio('tn', 'tn + fn')} as precision_0, {_ratio('tn', 'tn + fp')} as recall_0, {_ratio('2 * tn', '2 * tn + fn + fp')} as f1_0, tn + fp as support_0,
  {_ratio('tp', 'tp + fp')} as precision_1, {_ratio('tp', 'tp + fn')} as recall_1, {_ratio('2 * tp', '2 * tp + fp + fn')} as f1_1, fn + tp as support_1"""


def _metrics_sql(source: str, threshold: float, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""with {source}, hit as (select *, (score >= {threshold}::double)::int as p from pred),
c as (select {k}{_COUNTS} from hit {f'group by {key}' if key else ''}),
m as (select {k}tn, fp, fn, tp, tn + fp + fn + tp as n, {_CLASSES},
  {_ratio('tn', 'tn + fp')} as rate_00, {_ratio('fp', 'tn + fp')} as rate_01, {_ratio('fn', 'fn + tp')} as rate_10, {_ratio('tp', 'fn + tp')} as rate_11 from c)
select *, (precision_0 + precision_1) / 2 as macro_precision, (recall_0 + recall_1) / 2 as macro_recall, (f1_0 + f1_1) / 2 as macro_f1 from m"""


@query("metrics_at_half", _metrics_sql(PREDICTIONS, 0.5))
def _(spark, sf):
    return metrics.binary_metrics(predictions(spark, sf), 0.5)


@query("metrics_tied", _metrics_sql(TIED, 0.45))
def _(spark, sf):
    return metrics.binary_metrics(tied_predictions(spark, sf), 0.45)


@query("metrics_by_kind", _metrics_sql(PREDICTIONS, 0.05, "kind"))
def _(spark, sf):
    return metrics.binary_metrics(predictions(spark, sf), 0.05, "kind")


@query(
    "classification_report",
    f"""with {TIED}, hit as (select *, (score >= 0.45::double)::int as p from pred), c as (select {_COUNTS} from hit),
m as (select *, tn + fp + fn + tp as n, {_CLASSES} from c)
select '0' as row, precision_0 as precision, recall_0 as recall, f1_0 as f1, support_0 as support from m
union all select '1', precision_1, recall_1, f1_1, support_1 from m
union all select 'accuracy', accuracy, accuracy, accuracy, n from m
union all select 'macro avg', (precision_0 + precision_1) / 2, (recall_0 + recall_1) / 2, (f1_0 + f1_1) / 2, n from m
union all select 'weighted avg', (precision_0 * support_0 + precision_1 * support_1) / n::double, (recall_0 * support_0 + recall_1 * support_1) / n::double, (f1_0 * support_0 + f1_1 * support_1) / n::double, n from m""",
)
def _(spark, sf):
    return metrics.classification_report(tied_predictions(spark, sf), 0.45)


_OUTCOME = "case when y_true = 1 and p = 1 then 'TP' when y_true = 0 and p = 0 then 'TN' when y_true = 0 then 'FP' else 'FN' end"
_OUTCOMES = f"with {PREDICTIONS}, o as (select *, 0.05::double as threshold, p as y_pred, {_OUTCOME} as outcome from (select *, (score >= 0.05::double)::int as p from pred))"


@query("outcome_labels", f"{_OUTCOMES} select relative_path, y_true, score, kind, threshold, y_pred, outcome from o")
def _(spark, sf):
    return metrics.prediction_table(predictions(spark, sf), 0.05)


@query("errors_only", f"{_OUTCOMES} select relative_path, y_true, score, kind, threshold, y_pred, outcome from o where outcome in ('FP', 'FN')")
def _(spark, sf):
    return metrics.errors_only(predictions(spark, sf), 0.05)


@query("outcome_counts", f"{_OUTCOMES} select outcome, count(*) as n from o group by outcome")
def _(spark, sf):
    return metrics.outcome_counts(predictions(spark, sf), 0.05)


@query(
    "top_example_per_outcome",
    f"""{_OUTCOMES}, r as (select *, row_number() over (partition by outcome order by case when outcome in ('TP', 'FP') then -score else score end, relative_path) as k from o)
select d.outcome, relative_path, score, y_true from (values ('TP'), ('TN'), ('FP'), ('FN')) d(outcome) left join (select * from r where k = 1) r on r.outcome = d.outcome""",
)
def _(spark, sf):
    return metrics.examples(predictions(spark, sf), 0.05)


def _curve_sql(source: str) -> str:
    return f"""with {source}, s as (
  select threshold, sum(pos) as pos, sum(neg) as neg from (
    select score as threshold, y_true as pos, 1 - y_true as neg from pred where score between 0 and 1
    union all select unnest([0.0::double, 0.5::double, 1.0::double]), 0, 0) group by threshold
), w as (
  select threshold, (sum(pos) over d)::bigint as tp, (sum(neg) over d)::bigint as fp, (sum(pos) over ())::bigint as n_pos, (sum(neg) over ())::bigint as n_neg
  from s window d as (order by threshold desc rows unbounded preceding)
), curve as (
  select threshold, tp, fp, n_pos - tp as fn, n_neg - fp as tn, {_ratio('tp', 'tp + fp')} as precision, {_ratio('tp', 'n_pos')} as recall, {_ratio('2 * tp', 'tp + fp + n_pos')} as f1 from w
)"""


_BEST = " select * from curve order by f1 desc, recall desc, abs(threshold - 0.5), threshold limit 1"


@query("threshold_curve", _curve_sql(PREDICTIONS) + " select * from curve")
def _(spark, sf):
    return metrics.threshold_curve(predictions(spark, sf))


@query("threshold_best", _curve_sql(PREDICTIONS) + _BEST)
def _(spark, sf):
    return metrics.best_threshold(predictions(spark, sf))


@query("threshold_curve_tied", _curve_sql(TIED) + " select * from curve")
def _(spark, sf):
    return metrics.threshold_curve(tied_predictions(spark, sf))


@query("threshold_best_tied", _curve_sql(TIED) + _BEST)
def _(spark, sf):
    return metrics.best_threshold(tied_predictions(spark, sf))


@query("class_weights", f"with {MANIFEST}, c as (select label, count(*) as n from manifest group by label) select label, n, (sum(n) over ())::double / (2 * n) as weight from c")
def _(spark, sf):
    return metrics.class_weights(manifests(spark, sf))


# Duplicates, conflicts, curation

_DUPS = f"with {MANIFEST}, g as (select sha256, count(*) as n from manifest where sha256 <> '' group by sha256 having count(*) > 1)"
_CONFLICT = f"""with {MANIFEST}, g as (
  select sha256, count(*) as n, string_agg(distinct label::varchar, '|' order by label::varchar) as labels from manifest group by sha256 having count(distinct label) > 1
)"""


@query("dup_groups", f"{_DUPS} select * from g")
def _(spark, sf):
    return curation.duplicate_groups(manifests(spark, sf))


@query("dup_summary", f"{_DUPS} select count(*) as n_groups, coalesce(sum(n), 0)::bigint as n_rows from g")
def _(spark, sf):
    return curation.duplicate_summary(manifests(spark, sf))


@query("dup_top20", f"{_DUPS} select * from g order by n desc, sha256 limit 20")
def _(spark, sf):
    return curation.largest_duplicates(manifests(spark, sf))


@query("dup_flags", f"with {MANIFEST} select relative_path, count(*) over (partition by sha256) > 1 as is_duplicated from manifest")
def _(spark, sf):
    return curation.duplicated(manifests(spark, sf), "sha256").select("relative_path", "is_duplicated")


@query("conflict_hashes", f"{_CONFLICT} select sha256, n from g")
def _(spark, sf):
    return curation.conflicting_hashes(manifests(spark, sf))


@query(
    "conflict_rows",
    f"""{_CONFLICT} select m.sha256 as exact_sha256, relative_path, label, surface, source_group, n as hash_group_row_count, labels as conflicting_labels,
'exact_hash_label_conflict' as exclusion_reason from manifest m join g using (sha256)""",
)
def _(spark, sf):
    return curation.conflict_rows(manifests(spark, sf))


@query("conflict_detail", f"{_CONFLICT} select m.sha256 as exact_sha256, count(*) as n, min(labels) as labels, min(relative_path) as first_path, max(relative_path) as last_path from manifest m join g using (sha256) group by m.sha256")
def _(spark, sf):
    return curation.conflict_detail(manifests(spark, sf))


@query("curated_manifest", f"{_CONFLICT} select m.* from manifest m anti join g using (sha256)")
def _(spark, sf):
    return curation.curated(manifests(spark, sf))


@query(
    "curation_counts",
    f"""{_CONFLICT}, x as (select m.*, g.sha256 is not null as goes from manifest m left join g using (sha256))
select count(*) as parent_rows, count(*) filter (goes) as excluded_rows, count(*) filter (not goes) as curated_rows, count(distinct sha256) filter (goes) as conflicting_hashes,
count(*) filter (label = 0) as parent_label_0, count(*) filter (label = 1) as parent_label_1, count(*) filter (label = 0 and not goes) as curated_label_0, count(*) filter (label = 1 and not goes) as curated_label_1,
count(distinct source_group) as parent_groups, count(distinct source_group) filter (not goes) as curated_groups from x""",
)
def _(spark, sf):
    return curation.curation_counts(manifests(spark, sf))


@query(
    "lineage_partition_check",
    f"""{_CONFLICT}, kept as (select relative_path from manifest anti join g using (sha256)), bad as (select relative_path from manifest join g using (sha256))
select (select count(*) from (select * from kept intersect select * from bad)) as overlap,
(select count(*) from (select relative_path from manifest except all (select * from kept union all select * from bad))) as missing,
(select count(*) from ((select * from kept union all select * from bad) except all select relative_path from manifest)) as extra""",
)
def _(spark, sf):
    m = manifests(spark, sf)
    return curation.partition_check(m, curation.curated(m), curation.conflict_rows(m))


@query(
    "column_drift",
    f"""with {MANIFEST}, b as (select relative_path, case when label = 1 then surface else upper(surface) end as surface, label, source_group from manifest where label = 0 or file_size_bytes > 1000)
select c.column_name, case c.column_name when 'surface' then s when 'label' then l else g end as n_different from (
  select count(*) filter (a.surface is distinct from b.surface) as s, count(*) filter (a.label is distinct from b.label) as l, count(*) filter (a.source_group is distinct from b.source_group) as g
  from manifest a join b using (relative_path)) cross join (values ('surface'), ('label'), ('source_group')) c(column_name)""",
)
def _(spark, sf):
    m = manifests(spark, sf)
    changed = m.where((F.col("label") == 0) | (F.col("file_size_bytes") > 1000)).withColumn("surface", F.when(F.col("label") == 1, F.col("surface")).otherwise(F.upper("surface")))
    return curation.column_drift(m, changed, "relative_path", ["surface", "label", "source_group"])


@query("fd_violations", f"with {MANIFEST} select sha256, count(distinct source_group) as n_values from manifest group by sha256 having count(distinct source_group) > 1")
def _(spark, sf):
    return curation.functional_dependency_violations(manifests(spark, sf), "sha256", "source_group")


# Profiles and audits


@query(
    "profile_grouping_sets",
    f"""with {MANIFEST}, g as (select surface, label, split, count(*) as n, grouping(surface) as a, grouping(label) as b, grouping(split) as c from manifest group by grouping sets ((surface), (label), (surface, label), (split), ()))
select case when a = 0 and b = 0 then 'surface*label' when a = 0 then 'surface' when b = 0 then 'label' when c = 0 then 'split' else 'total' end as grouping,
case when a = 0 and b = 0 then surface || '|' || label when a = 0 then surface when b = 0 then label::varchar when c = 0 then split else '' end as key, n from g""",
)
def _(spark, sf):
    return profile.profile(manifests(spark, sf), [("surface",), ("label",), ("surface", "label"), ("split",), ()])


@query("dataset_summary", f"with {MANIFEST} select split, surface, label, count(*) as n_rows, count(distinct source_group) as n_groups from manifest group by all")
def _(spark, sf):
    return profile.dataset_summary(manifests(spark, sf))


@query("split_overview", f"with {MANIFEST} select split, count(*) as images, count(distinct source_group) as groups, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative from manifest group by split")
def _(spark, sf):
    return profile.split_overview(manifests(spark, sf))


_TARGET = "case split when 'train' then 0.70::double else 0.15::double end"
_AUDIT = f"""with {MANIFEST}, c as (
  select split, n_rows, n_groups, n_rows::double / (sum(n_rows) over ())::double as fraction from (select split, count(*) as n_rows, count(distinct source_group) as n_groups from manifest group by split)
), grid as (
  select s.split, k.surface, k.label, coalesce(n, 0) as n from (values ('train'), ('validation'), ('test')) s(split) cross join (select distinct surface, label from manifest) k
  left join (select split, surface, label, count(*) as n from manifest group by all) m on m.split = s.split and m.surface = k.surface and m.label = k.label
), strata as (
  select split, surface, label, n, stratum_total, case when stratum_total = 0 then 0.0::double else n::double / stratum_total end as fraction from (select *, (sum(n) over (partition by surface, label))::bigint as stratum_total from grid)
)"""


@query("split_audit_counts", f"{_AUDIT} select *, abs(fraction - {_TARGET}) as deviation from c")
def _(spark, sf):
    return audit.counts(manifests(spark, sf))


@query("split_audit_strata", f"{_AUDIT} select * from strata")
def _(spark, sf):
    return audit.strata(manifests(spark, sf))


@query(
    "split_balance_violations",
    f"""{_AUDIT} select 'stratum' as kind, split, surface || '|' || label as key, n, fraction from strata where n = 0 or abs(fraction - {_TARGET}) > 0.10::double + 1e-12::double
union all select 'split', split, '', n_rows, fraction from c where abs(fraction - {_TARGET}) > 0.05::double + 1e-12::double
union all select 'surface', split, surface, n, fraction from (select split, surface, sum(n)::bigint as n, sum(n)::double / sum(stratum_total)::double as fraction from strata group by split, surface)
where abs(fraction - {_TARGET}) > 0.05::double + 1e-12::double""",
)
def _(spark, sf):
    return audit.violations(manifests(spark, sf))


@query(
    "split_overlaps",
    f"""with {MANIFEST}, long as (select split, 'relative_path' as column_name, relative_path as value from manifest union all select split, 'source_group', source_group from manifest union all select split, 'sha256', sha256 from manifest),
f as (select column_name, value, bool_or(split = 'train') as a, bool_or(split = 'validation') as b, bool_or(split = 'test') as c from long group by all)
select column_name, pair, case pair when 'train|validation' then x when 'train|test' then y else z end as n_shared from (
  select column_name, count(*) filter (a and b) as x, count(*) filter (a and c) as y, count(*) filter (b and c) as z from f group by column_name) cross join (values ('train|validation'), ('train|test'), ('validation|test')) p(pair)""",
)
def _(spark, sf):
    return audit.overlaps(manifests(spark, sf))


@query("class_pivot", f"with {MANIFEST} select split, count(*) filter (surface = 'en') as c_en, count(*) filter (surface = 'de') as c_de, count(*) filter (surface = 'fr') as c_fr, count(*) filter (surface = 'es') as c_es from manifest group by split")
def _(spark, sf):
    return profile.class_pivot(manifests(spark, sf), "split", "surface", ["en", "de", "fr", "es"])


@query("class_unpivot", f"with {MANIFEST}, w as (select split, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative from manifest group by split) select split, 'positive' as kind, positive as n from w union all select split, 'negative', negative from w")
def _(spark, sf):
    wide = profile.split_overview(manifests(spark, sf)).select("split", "positive", "negative")
    return profile.unpivot(wide, ["split"], ["positive", "negative"], "kind", "n")


@query("distinct_values", f"with {MANIFEST} select distinct source_group from manifest")
def _(spark, sf):
    return profile.distinct_values(manifests(spark, sf), "source_group")


@query("seeded_sample")
def _(spark, sf):
    return profile.sample(manifests(spark, sf), 100, 42, "relative_path")


# Latency and histories

_LATENCY = "count({v}) as n, avg({v}) as mean_ms, median({v}) as median_ms, quantile_cont({v}, 0.5) as p50_ms, quantile_cont({v}, 0.95) as p95_ms, min({v}) as min_ms, max({v}) as max_ms, quantile_cont({v}, 0.95) <= 5000.0 as target_met"


@query("latency_summary", f"select {_LATENCY.format(v='l_quantity')} from lineitem")
def _(spark, sf):
    return history.latency(table(spark, sf, "lineitem"), "l_quantity", 5000.0)


@query("latency_by_type", f"select l_shipmode, {_LATENCY.format(v='l_quantity')} from (select l_returnflag as l_shipmode, l_quantity from lineitem) group by l_shipmode")
def _(spark, sf):
    return history.latency(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "l_shipmode"), "l_quantity", 5000.0, "l_shipmode")


@query("history_global_epoch", f"with {HISTORY} select *, row_number() over (partition by run, phase order by epoch) as phase_epoch, row_number() over (partition by run order by case phase when 'head' then 1 else 2 end, epoch) as global_epoch from history")
def _(spark, sf):
    return history.global_epochs(histories(spark, sf), "run", ["head", "fine_tune"])


@query(
    "history_best",
    f"""with {HISTORY}, b as (select run, arg_min(epoch, (val_loss, epoch)) as best_epoch, min(val_loss) as best_loss, count(*) as n_epochs, max(epoch) as last_epoch from history group by run)
select b.*, (select count(*) from history h where h.run = b.run and h.epoch > b.best_epoch) as early_wait from b""",
)
def _(spark, sf):
    return history.best_epochs(histories(spark, sf), "run")


@query(
    "history_lr_changes",
    f"""with {HISTORY}, l as (select run, row_number() over w as pos, lag(learning_rate) over w as before, learning_rate from history window w as (partition by run order by epoch)),
m as (select *, before is not null and abs(learning_rate - before) > 1e-12 * greatest(abs(learning_rate), abs(before)) as changed from l)
select run, count(*) filter (changed) as n_changes, max(pos) - coalesce(max(pos) filter (changed), 1) as reduce_wait from m group by run""",
)
def _(spark, sf):
    return history.learning_rate_changes(histories(spark, sf), "run")


@query("history_dedupe", f"with {HISTORY} select run, epoch, val_loss + (epoch % 3 = 0)::int as val_loss, 1 + (epoch % 3 = 0)::int as line from history")
def _(spark, sf):
    h = histories(spark, sf).select("run", "epoch", "val_loss", F.lit(1).alias("line"))
    again = h.where("epoch % 3 = 0").select("run", "epoch", (F.col("val_loss") + 1).alias("val_loss"), F.lit(2).alias("line"))
    return history.keep_last(h.unionByName(again), ["run", "epoch"], "line")


@query("history_conflicts", f"with {HISTORY} select run, epoch, 2::bigint as n, 2::bigint as n_values from history where epoch % 3 = 0")
def _(spark, sf):
    h = histories(spark, sf).select("run", "epoch", "val_loss")
    again = h.where("epoch % 3 < 2").select("run", "epoch", (F.col("val_loss") + (F.col("epoch") % 3 == 0).cast("int")).alias("val_loss"))
    return history.conflicting_epochs(h.unionByName(again), ["run", "epoch"], ["val_loss"])


@query("history_concat", f"with {HISTORY} select run, epoch, val_loss, null::double as learning_rate, 'head' as phase from history where phase = 'head' union all select run, epoch, val_loss, learning_rate, 'fine_tune' from history where phase <> 'head'")
def _(spark, sf):
    h = histories(spark, sf)
    return history.concatenated(h.where("phase = 'head'").select("run", "epoch", "val_loss"), h.where("phase <> 'head'").select("run", "epoch", "val_loss", "learning_rate"))


@query("select_winner", f"with {HISTORY} select run, min(val_loss) as loss from history group by run order by loss, run limit 1")
def _(spark, sf):
    runs = histories(spark, sf).groupBy("run").agg(F.min("val_loss").alias("loss"))
    return history.winner(runs, "loss", "run")


# Reconciliation


@query(
    "prediction_coverage",
    f"""with {MANIFEST}, p as (select relative_path, case when file_size_bytes % 7 = 0 then 1 - label else label end as y_true, case when file_size_bytes % 11 = 0 then '' else sha256 end as sha256 from manifest where split = 'test' and file_size_bytes % 5 <> 0
  union all select 'extra/' || relative_path, label, sha256 from manifest where file_size_bytes % 13 = 0),
t as (select * from manifest where split = 'test')
select count(*) filter (p.relative_path is not null and t.relative_path is not null) as n_matched, count(*) filter (p.relative_path is null) as n_missing, count(*) filter (t.relative_path is null) as n_extra,
count(*) filter (p.relative_path is not null and t.relative_path is not null and p.y_true is distinct from t.label) as n_label_mismatch,
count(*) filter (p.relative_path is not null and t.relative_path is not null and p.sha256 is distinct from t.sha256) as n_sha_mismatch from p full join t on p.relative_path = t.relative_path""",
)
def _(spark, sf):
    m = manifests(spark, sf)
    size = F.col("file_size_bytes")
    p = m.where((F.col("split") == "test") & (size % 5 != 0)).select("relative_path", F.when(size % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("y_true"), F.when(size % 11 == 0, "").otherwise(F.col("sha256")).alias("sha256"))
    extra = m.where(size % 13 == 0).select(F.concat(F.lit("extra/"), "relative_path").alias("relative_path"), F.col("label").alias("y_true"), "sha256")
    return reconcile.prediction_coverage(p.unionByName(extra), m.where("split = 'test'"))


@query(
    "group_map_coverage",
    f"""with {MANIFEST}, g as (select relative_path from manifest where file_size_bytes % 3 <> 0 union all select 'x' || relative_path from manifest where file_size_bytes % 17 = 0)
select count(*) filter (m.relative_path is not null and g.relative_path is not null) as n_both, count(*) filter (g.relative_path is null) as n_left_only, count(*) filter (m.relative_path is null) as n_right_only
from (select distinct relative_path from manifest) m full join (select distinct relative_path from g) g on m.relative_path = g.relative_path""",
)
def _(spark, sf):
    m = manifests(spark, sf)
    g = m.where("file_size_bytes % 3 <> 0").select("relative_path").unionByName(m.where("file_size_bytes % 17 = 0").select(F.concat(F.lit("x"), "relative_path").alias("relative_path")))
    return reconcile.coverage(m, g, "relative_path")


@query("sha_mismatch", f"with {MANIFEST} select relative_path, sha256 as observed, sha256('x' || sha256) as recorded from manifest where file_size_bytes % 19 = 0 and file_size_bytes % 2 = 0")
def _(spark, sf):
    m = manifests(spark, sf)
    size = F.col("file_size_bytes")
    g = m.select("relative_path", F.when((size % 19 == 0) & (size % 2 == 0), F.sha2(F.concat(F.lit("x"), "sha256").cast("binary"), 256)).when(size % 19 == 0, "").otherwise(F.col("sha256")).alias("sha256"))
    return reconcile.stale_hashes(m, g)


@query("sort_experiments", """with e as (select case when c_custkey % 5 = 4 then c_mktsegment else 'E' || (c_custkey % 7) end as name, c_acctbal as threshold, c_custkey as run from customer),
r as (select *, case when regexp_matches(name, '^[Ee][0-9]+$') then regexp_extract(name, '^[Ee]([0-9]+)$', 1)::int else 999 end as rank from e)
select *, row_number() over (order by rank, name, threshold, run) as position from r""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    e = c.select(F.when(F.col("c_custkey") % 5 == 4, F.col("c_mktsegment")).otherwise(F.concat(F.lit("E"), (F.col("c_custkey") % 7).cast("string"))).alias("name"), F.col("c_acctbal").alias("threshold"), F.col("c_custkey").alias("run"))
    return reconcile.sorted_experiments(e, "name", "threshold", "run")


@query("consistent_value", f"with {MANIFEST} select count(distinct split) as n_values from manifest where split in ('train', 'test')")
def _(spark, sf):
    m = manifests(spark, sf)
    return reconcile.consistent_value(m.where("split = 'train'"), m.where("split = 'test'"), column="split")


# Fingerprints


@query("fingerprint_ordered", f"with {MANIFEST} select count(*) as n_rows, sha256(string_agg(concat_ws(chr(0), relative_path, sha256, file_size_bytes), chr(10) order by relative_path)) as fingerprint, sum(file_size_bytes)::bigint as n_bytes from manifest")
def _(spark, sf):
    return fingerprint.content(manifests(spark, sf))


@query("fingerprint_canonical", f"with {MANIFEST} select count(*) as n_rows, sha256(string_agg(concat_ws(chr(0), file_size_bytes, label, relative_path, sha256, source_group, split, surface), chr(10) order by relative_path)) as fingerprint from manifest")
def _(spark, sf):
    return fingerprint.canonical(manifests(spark, sf))


@query(
    "fingerprint_parts",
    f"""with {MANIFEST}, p as (select ('0x' || substr(sha256(relative_path), 1, 8))::bigint % 16 as part, concat_ws(chr(0), file_size_bytes, label, relative_path, sha256, source_group, split, surface) as line, relative_path from manifest),
h as (select part, count(*) as n, sha256(string_agg(line, chr(10) order by relative_path)) as h from p group by part)
select sum(n)::bigint as n_rows, sha256(string_agg(part || ':' || h, chr(10) order by part)) as fingerprint from h""",
)
def _(spark, sf):
    return fingerprint.canonical(manifests(spark, sf), parts=16)


# Paths, labels, checks

_PATHS = """p as (select page_id, url, case page_id % 8 when 0 then 'D/CD/' || page_id || '-1.jpg' when 1 then './W/UW/' || page_id || '.jpg' when 2 then 'P\\CP\\' || page_id || '-2.jpg' when 3 then '../D/CD/' || page_id
  when 4 then 'C:/D/UD/' || page_id when 5 then 'D/CD/UD/' || page_id when 6 then '/P/UP/' || page_id else 'other/' || page_id end as path from pages),
n as (select page_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path from p)"""


def _paths(spark, sf):
    i = F.col("page_id").cast("string")
    forms = [("D/CD/", "-1.jpg"), ("./W/UW/", ".jpg"), ("P\\CP\\", "-2.jpg"), ("../D/CD/", ""), ("C:/D/UD/", ""), ("D/CD/UD/", ""), ("/P/UP/", ""), ("other/", "")]
    path = None
    for k, (a, b) in enumerate(forms):
        value = F.concat(F.lit(a), i, F.lit(b))
        path = F.when(F.col("page_id") % 8 == k, value) if path is None else path.when(F.col("page_id") % 8 == k, value)
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query(
    "path_parse",
    f"""with {_PATHS}, c as (select page_id, path, list_filter(string_split(path, '/'), lambda x: x in ('CD', 'UD', 'CP', 'UP', 'CW', 'UW')) as f from n)
select page_id, path, case when len(f) = 1 then substr(f[1], 2, 1) end as surface, case when len(f) = 1 then (substr(f[1], 1, 1) = 'C')::int end as label from c""",
)
def _(spark, sf):
    found = scalar.class_of_path("path")
    return _paths(spark, sf).select("page_id", scalar.portable_path("path").alias("path"), found["surface"].alias("surface"), found["label"].alias("label"))


@query("path_safety", f"with {_PATHS} select page_id, not (path = '' or starts_with(path, '/') or regexp_matches(path, '(^|/)\\.\\.(/|$)') or regexp_matches(path, '^[A-Za-z]:')) as is_safe from n")
def _(spark, sf):
    return _paths(spark, sf).select("page_id", scalar.safe_path("path").alias("is_safe"))


@query("path_regex_group", f"with {_PATHS} select page_id, regexp_extract(path, '([0-9]+)-[0-9]+\\.jpg$', 1) as source_group from n")
def _(spark, sf):
    return _paths(spark, sf).select("page_id", scalar.group_of_path("path", r"([0-9]+)-[0-9]+\.jpg$").alias("source_group"))


@query(
    "label_strictness",
    """with v as (select c_custkey, case c_custkey % 6 when 0 then '0' when 1 then ' 1 ' when 2 then '1.0' when 3 then '0.5' when 4 then 'true' else '' end as raw from customer)
select c_custkey, case when try_cast(trim(raw) as double) in (0, 1) then try_cast(trim(raw) as double)::int end as label from v""",
)
def _(spark, sf):
    raw = None
    for k, v in enumerate(["0", " 1 ", "1.0", "0.5", "true", ""]):
        raw = F.when(F.col("c_custkey") % 6 == k, v) if raw is None else raw.when(F.col("c_custkey") % 6 == k, v)
    return table(spark, sf, "customer").select("c_custkey", scalar.strict_label(raw).alias("label"))


@query("truthy_flags", "select c_custkey, coalesce(lower(trim(raw)) in ('1', 'true', 'yes', 'y', 'verified'), false) as verified from (select c_custkey, case c_custkey % 5 when 0 then ' YES ' when 1 then 'no' when 2 then '1' when 3 then 'Verified' end as raw from customer)")
def _(spark, sf):
    raw = F.when(F.col("c_custkey") % 5 == 0, " YES ").when(F.col("c_custkey") % 5 == 1, "no").when(F.col("c_custkey") % 5 == 2, "1").when(F.col("c_custkey") % 5 == 3, "Verified")
    return table(spark, sf, "customer").select("c_custkey", scalar.truthy(raw).alias("verified"))


@query(
    "manifest_checks",
    f"""with {MANIFEST} select 'surface_values' as check_name, count(*) filter (surface not in ('en', 'de', 'fr')) as n_violations, min(relative_path) filter (surface not in ('en', 'de', 'fr')) as example from manifest
union all select 'sha256_shape', count(*) filter (not regexp_full_match(sha256, '[0-9a-f]{{64}}')), min(relative_path) filter (not regexp_full_match(sha256, '[0-9a-f]{{64}}')) from manifest
union all select 'label_values', count(*) filter (label not in (0, 1)), min(relative_path) filter (label not in (0, 1)) from manifest
union all select 'source_group_blank', count(*) filter (source_group = ''), min(relative_path) filter (source_group = '') from manifest
union all select 'split_values', count(*) filter (split not in ('train', 'validation', 'test')), min(relative_path) filter (split not in ('train', 'validation', 'test')) from manifest""",
)
def _(spark, sf):
    return checks.violations(manifests(spark, sf), [checks.surface_values(values=("en", "de", "fr")), checks.sha_shape(), checks.label_values(), checks.not_blank("source_group"), checks.split_values()])


@query("null_cells", "select 'doc_id' as column_name, count(*) filter (doc_id is null) as n_null from documents union all select 'text', count(*) filter (text is null) from documents union all select 'lang', count(*) filter (lang is null) from documents union all select 'source', count(*) filter (source is null) from documents union all select 'n_chars', count(*) filter (n_chars is null) from documents")
def _(spark, sf):
    return checks.null_cells(table(spark, sf, "documents"))


# Graph, allocation, model


@query(
    "components_min_label",
    """with recursive e as (select distinct doc_id % 97 as g, sha256(text) as h from documents),
n as (select distinct a.g as x, b.g as y from e a join e b using (h)),
r as (select g as x, g as y from (select distinct g from e) union select r.x, n.y from r join n on r.y = n.x)
select x as source_group, min(y) as component from r group by x""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 97).alias("source_group"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return components.components(docs, "source_group", "sha256")


@query("allocate_groups")
def _(spark, sf):
    return split.allocate_groups(allocation(spark, sf))


@query("allocation_audit")
def _(spark, sf):
    frame = allocation(spark, sf).withColumn("split", F.lit(None).cast("string"))
    return audit.counts(split.assign(frame, split.allocate_groups(frame)))


@query("model_scores_metrics")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("relative_path"), (F.col("label") < 2).cast("int").alias("y_true"), "embedding", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"))
    fitted = model.train(rows.where("split = 'train'"), "embedding")
    return metrics.binary_metrics(model.score(fitted, rows.where("split = 'test'"), "embedding"), 0.5)
