"""Queries of single operators that no larger query shows, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalith.functions import scalar
from curalith.operators import checks, fingerprint, frames, reconcile
from curalith.plans.adapters import HISTORY, MANIFEST, PREDICTIONS, predictions, table
from curalith.plans.adapters import history as histories
from curalith.plans.adapters import manifest as manifests
from curalith.plans.register import query


def _case(key: str, values: list) -> Column:
    """The value at key modulo the number of values; None is null."""
    out = None
    for k, v in enumerate(values):
        hit = F.col(key) % len(values) == k
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


def _case_sql(key: str, values: list) -> str:
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(quoted)) + " end"


# A manifest with blemishes, made of customers

_SPLIT = ["", " Test ", "TEST", None, "train", "  "]
_STATUS = ["ok", "OK ", "bad", None, "ok"]
_VERIFIED = ["yes", "1", "no", None, " True ", "verified", "0"]
_SURFACE = ["D", "P", "W"]
_FOLDER = ["CD", "UP", "CW", "CD", "UP"]


def _blemished(spark, sf):
    path = F.concat(_case("c_custkey", _FOLDER), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    return table(spark, sf, "customer").select(
        "c_custkey", path.alias("relative_path"), _case("c_custkey", _SURFACE).alias("surface"), (F.col("c_custkey") % 2).alias("label"), _case("c_custkey", _SPLIT).alias("split"),
        _case("c_custkey", _STATUS).alias("audit_status"), _case("c_custkey", _VERIFIED).alias("source_group_verified"), F.col("c_nationkey").cast("string").alias("source_group"),
        _case("c_custkey", ["self_captured", "self_captured", "web", None]).alias("capture_source"),
    )


_BLEMISHED = f"""bad as (select c_custkey, concat({_case_sql('c_custkey', _FOLDER)}, '/', c_custkey, '.jpg') as relative_path, {_case_sql('c_custkey', _FOLDER)} as folder,
  {_case_sql('c_custkey', _SURFACE)} as surface, c_custkey % 2 as label, {_case_sql('c_custkey', _SPLIT)} as split, {_case_sql('c_custkey', _STATUS)} as audit_status,
  {_case_sql('c_custkey', _VERIFIED)} as source_group_verified, c_nationkey::varchar as source_group, {_case_sql('c_custkey', ['self_captured', 'self_captured', 'web', None])} as capture_source from customer)"""


def _violations_sql(source: str, rules: dict[str, str], key: str = "relative_path") -> str:
    """Rules say what is right; null counts as wrong."""
    parts = [f"select '{name}' as check_name, count(*) filter (not coalesce({right}, false)) as n_violations, min({key}) filter (not coalesce({right}, false)) as example from bad" for name, right in rules.items()]
    return f"with {source} " + " union all ".join(parts)


@query(
    "curation_checks",
    _violations_sql(
        _BLEMISHED,
        {
            "source_group_verified_true": "lower(trim(source_group_verified)) in ('1', 'true', 'yes', 'y', 'verified')",
            "audit_status_ok": "lower(trim(audit_status)) = 'ok'",
            "split_not_blank": "trim(coalesce(split, '')) = ''",
            "path_agrees": "substr(folder, 2, 1) = surface and (substr(folder, 1, 1) = 'C')::int = label",
            "label_lenient": "label in (0, 1)",
            "relative_path_safe": "true",
        },
    ),
)
def _(spark, sf):
    rules = [checks.verified(), checks.audit_ok(exact=False), checks.split_blank(), checks.path_agrees(), checks.lenient_label(), checks.path_safe()]
    return checks.violations(_blemished(spark, sf), rules)


@query("audit_exact", _violations_sql(_BLEMISHED, {"audit_status_ok": "audit_status = 'ok'"}))
def _(spark, sf):
    return checks.violations(_blemished(spark, sf), [checks.audit_ok()])


@query(
    "external_checks",
    _violations_sql(_BLEMISHED, {"capture_source_self": "capture_source = 'self_captured'", "label_values": "label in (0, 1)", "relative_path_safe": "true", "split_external": "coalesce(lower(trim(split)), '') not in ('train', 'validation', 'test')"}),
)
def _(spark, sf):
    return checks.violations(_blemished(spark, sf), checks.external_checks())


@query("rows_of_split", f"with {_BLEMISHED} select c_custkey, split from bad where lower(trim(split)) = 'test'")
def _(spark, sf):
    return frames.of_split(_blemished(spark, sf), "test").select("c_custkey", "split")


@query("rows_not_ok", f"with {_BLEMISHED} select c_custkey, audit_status from bad where audit_status is distinct from 'ok'")
def _(spark, sf):
    return frames.of_status(_blemished(spark, sf), ok=False).select("c_custkey", "audit_status")


@query("filled_groups", f"with {_BLEMISHED} select source_group, count(*) as n from bad group by source_group having count(*) >= 5")
def _(spark, sf):
    return frames.filled_groups(_blemished(spark, sf), "source_group", 5)


@query("verified_all_any", f"with {_BLEMISHED}, v as (select source_group, coalesce(lower(trim(source_group_verified)) in ('1', 'true', 'yes', 'y', 'verified'), false) as v from bad) select source_group, bool_and(v) as all_true, bool_or(v) as any_true from v group by source_group")
def _(spark, sf):
    return frames.all_any(_blemished(spark, sf), "source_group", scalar.truthy("source_group_verified"))


@query("repeated_keys", "select source, lang, count(*) as n from documents group by source, lang having count(*) > 1")
def _(spark, sf):
    return checks.unique(table(spark, sf, "documents"), "source", "lang")


@query("vocabulary", f"with {MANIFEST}, w as (select unnest(['en', 'de', 'xx']) as value), f as (select surface as value, count(*) as n from manifest group by surface) select coalesce(f.value, w.value) as value, coalesce(n, 0) as n, case when f.value is null then 'missing' when w.value is null then 'extra' else 'ok' end as state from f full join w on f.value = w.value")
def _(spark, sf):
    return frames.vocabulary(manifests(spark, sf), "surface", ["en", "de", "xx"])


@query("label_classes", "with f as (select label::bigint as value, count(*) as n from embeddings group by label), w as (select unnest([0::bigint, 1::bigint, 99::bigint]) as value) select coalesce(f.value, w.value) as value, coalesce(n, 0) as n, case when f.value is null then 'missing' when w.value is null then 'extra' else 'ok' end as state from f full join w on f.value = w.value")
def _(spark, sf):
    return frames.vocabulary(table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("label")), "label", [0, 1, 99])


# Predictions and histories

_SCORED = "bad as (select event_id::varchar as relative_path, (event_type = 'purchase')::int as y_true, value / 900.0::double as score, 0.4::double as threshold, (value / 900.0::double >= 0.4::double)::int as y_pred, case event_id % 4 when 0 then 'TP' when 1 then 'TN' when 2 then 'FP' else 'FN' end as outcome from events)"


@query(
    "prediction_checks",
    _violations_sql(_SCORED, {"score_range": "score between 0 and 1", "outcome_consistent": "outcome = case when y_true = 1 and y_pred = 1 then 'TP' when y_true = 0 and y_pred = 0 then 'TN' when y_true = 0 then 'FP' else 'FN' end", "y_true_values": "y_true in (0, 1)"}),
)
def _(spark, sf):
    score = F.col("value") / 900.0
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("relative_path"), (F.col("event_type") == "purchase").cast("int").alias("y_true"), score.alias("score"), F.lit(0.4).alias("threshold"), (score >= 0.4).cast("int").alias("y_pred"), _case("event_id", ["TP", "TN", "FP", "FN"]).alias("outcome"))
    return checks.violations(rows, [checks.score_range(), checks.outcome_consistent(), checks.label_values("y_true")])


_JOURNAL = f"{HISTORY}, bad as (select concat_ws('/', run, epoch) as relative_path, val_loss - 60 as loss, val_loss, learning_rate as accuracy, learning_rate * (1 + epoch % 3) as val_accuracy from history)"


@query(
    "history_checks",
    _violations_sql(_JOURNAL, {"loss_range": "loss >= 0", "val_loss_range": "val_loss >= 0", "accuracy_range": "accuracy between 0 and 1", "val_accuracy_range": "val_accuracy between 0 and 1"}),
)
def _(spark, sf):
    h = histories(spark, sf)
    rows = h.select(F.concat_ws("/", F.col("run").cast("string"), F.col("epoch").cast("string")).alias("relative_path"), (F.col("val_loss") - 60).alias("loss"), "val_loss", F.col("learning_rate").alias("accuracy"), (F.col("learning_rate") * (1 + F.col("epoch") % 3)).alias("val_accuracy"))
    return checks.violations(rows, checks.history_checks(rows.columns))


_OUT = "case when y_true = 1 and {p} = 1 then 'TP' when y_true = 0 and {p} = 0 then 'TN' when y_true = 0 then 'FP' else 'FN' end"


@query(
    "two_thresholds",
    f"with {PREDICTIONS}, t as (select *, (score >= 0.5::double)::int as y_pred_default, (score >= 0.05::double)::int as y_pred_tuned from pred) select *, {_OUT.format(p='y_pred_default')} as outcome_default, {_OUT.format(p='y_pred_tuned')} as outcome_tuned from t",
)
def _(spark, sf):
    return frames.two_thresholds(predictions(spark, sf), 0.5, 0.05)


@query("durations", f"with {HISTORY} select run, sum(val_loss) as total, count(val_loss) as n from history group by run")
def _(spark, sf):
    return frames.total(histories(spark, sf), "run", "val_loss")


@query(
    "benchmark_agreement",
    "with s as (select avg(l_quantity) as mean, quantile_cont(l_quantity, 0.95) as p95, max(l_quantity) as most from lineitem), r as (select avg(l_quantity) as mean, quantile_cont(l_quantity, 0.95) as p95, max(l_quantity) + 1 as most from lineitem) select 'mean' as metric, abs(s.mean - r.mean) <= 1e-9 as agrees from s, r union all select 'p95', abs(s.p95 - r.p95) <= 1e-9 from s, r union all select 'most', abs(s.most - r.most) <= 1e-9 from s, r",
)
def _(spark, sf):
    q = table(spark, sf, "lineitem")
    stored = q.agg(F.avg("l_quantity").alias("mean"), F.percentile("l_quantity", 0.95).alias("p95"), F.max("l_quantity").alias("most"))
    return reconcile.summary_agreement(stored, q.agg(F.avg("l_quantity").alias("mean"), F.percentile("l_quantity", 0.95).alias("p95"), (F.max("l_quantity") + 1).alias("most")))


# Shapes

_PREFERRED = ["relative_path", "y_true", "absent", "score"]


@query("preferred_columns", f"with {PREDICTIONS} select relative_path, y_true, score from pred")
def _(spark, sf):
    return frames.prefer(predictions(spark, sf), _PREFERRED)


@query("inserted_column", f"with {PREDICTIONS} select relative_path, case y_true when 1 then 'Crack' else 'Non-crack' end as class_name, y_true, score, kind from pred")
def _(spark, sf):
    return frames.insert(predictions(spark, sf), 1, "class_name", F.when(F.col("y_true") == 1, "Crack").otherwise("Non-crack"))


@query("nested_fields", "select c_custkey, case when c_custkey % 3 <> 0 then c_mktsegment end as segment, case when c_custkey % 3 <> 0 and c_acctbal > 0 then c_acctbal end as balance from customer")
def _(spark, sf):
    inner = F.when(F.col("c_acctbal") > 0, F.struct(F.col("c_acctbal").alias("balance")))
    record = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_mktsegment").alias("segment"), inner.alias("account")))
    return table(spark, sf, "customer").select("c_custkey", record.alias("record")).select("c_custkey", "record.segment", "record.account.balance")


@query("first_of_each", "select l_partkey, l_orderkey * 10 + l_linenumber as place, l_quantity from (select *, row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber) as k from lineitem) where k = 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "l_quantity")
    return frames.first_of_each(rows, "l_partkey", "place", frames.position())  # as SQL on one thread; on several the tied row is any


@query("one_batch", "select n_nationkey, n_name from nation")
def _(spark, sf):
    return frames.one_batch(table(spark, sf, "nation").select("n_nationkey", "n_name"), 32, "n_nationkey")


@query("category_order", f"with {MANIFEST}, c as (select surface, count(*) as n from manifest group by surface) select surface, n, coalesce(list_position(['fr', 'en', 'de'], surface) - 1, 3)::int as place from c")
def _(spark, sf):
    return frames.in_order(manifests(spark, sf).groupBy("surface").agg(F.count("*").alias("n")), "surface", ["fr", "en", "de"])


@query("pivot_sum", f"with {MANIFEST} select split, " + ", ".join(f"coalesce(sum(file_size_bytes) filter (surface = '{v}'), 0)::bigint as s_{v}" for v in ("en", "de", "xx")) + " from manifest group by split")
def _(spark, sf):
    return frames.pivot_sum(manifests(spark, sf), "split", "surface", ["en", "de", "xx"], "file_size_bytes")


@query(
    "split_objective",
    f"""with {MANIFEST}, shares as (select unnest(['train', 'validation', 'test']) as split, unnest([0.7::double, 0.15::double, 0.15::double]) as share),
cells as (select split, surface, label, count(*) as n from manifest group by all), strata as (select surface, label, count(*) as whole from manifest group by all),
a as (select avg(pow((coalesce(n, 0) - whole * share) / greatest(whole * share, 1.0::double), 2)) as v from strata cross join shares left join cells using (split, surface, label)),
t as (select split, count(*) as n, count(distinct source_group) as g from manifest group by split), w as (select count(*) as rows, count(distinct source_group) as groups from manifest),
b as (select avg(pow((coalesce(n, 0) - rows * share) / greatest(rows * share, 1.0::double), 2)) as v from shares left join t using (split), w),
c as (select avg(pow((coalesce(g, 0) - groups * share) / greatest(groups * share, 1.0::double), 2)) as v from shares left join t using (split), w)
select round(a.v + 0.35::double * b.v + 0.05::double * c.v, 9) as objective from a, b, c""",
)
def _(spark, sf):
    return frames.split_objective(manifests(spark, sf), {"train": 0.7, "validation": 0.15, "test": 0.15}).select(F.round("objective", 9).alias("objective"))


@query(
    "synthetic_manifest",
    "with i as (select range as id from range(60)), p as (select *, ['D', 'P', 'W'][(id // 20 + 1)::int] as surface, (id // 10) % 2 as label, lpad((id // 2)::varchar, 4, '0') as source_group from i), q as (select concat(surface, '/', case when label = 1 then 'C' else 'U' end, surface, '/', source_group, '-', id % 2, '.png') as relative_path, * from p) select relative_path, surface, label::bigint as label, source_group, sha256(relative_path) as sha256 from q",
)
def _(spark, sf):
    return frames.synthetic_manifest(spark, ["D", "P", "W"], 5, 2)


@query("label_target", "select event_id::varchar as relative_path, 'validation' as split, (event_type = 'view')::int as y_true from events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("relative_path"), F.lit("validation").alias("split"), (F.col("event_type") == "view").cast("int").alias("label"))
    return rows.withColumnRenamed("label", "y_true")


# Reconciliation


@query("lookup_rows", "select c_custkey, o_orderkey from customer left join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey) on c_custkey = o_custkey")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return reconcile.lookup(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey"])


@query(
    "field_agreement",
    "select c_custkey, (c_custkey % 2 + (c_custkey % 3 = 0)::int)::bigint as n_different, concat_ws(',', case when c_custkey % 2 = 1 then 'c_nationkey' end, case when c_custkey % 3 = 0 then 'c_mktsegment' end) as different from customer where c_custkey % 5 <> 0",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    other = c.where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_nationkey") + F.col("c_custkey") % 2).alias("c_nationkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return reconcile.field_agreement(c, other, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("allowed_provenance", "select c_custkey, c_nationkey, c_mktsegment from customer where (c_nationkey, c_mktsegment) in (select c_nationkey, c_mktsegment from customer where c_custkey % 50 = 0)")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return reconcile.allowed(c, c.where("c_custkey % 50 = 0"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("same_hashes", "with a as (select distinct sha256(text) as h from documents where doc_id % 3 <> 0), b as (select distinct sha256(text) as h from documents where doc_id % 3 <> 1) select (select count(*) from a where h in (from b)) as n_both, (select count(*) from a where h not in (from b)) as n_left_only, (select count(*) from b where h not in (from a)) as n_right_only")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return reconcile.same_set(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1"), "h")


@query(
    "changed_inputs",
    "select doc_id, case doc_id % 10 when 0 then 'removed' when 1 then 'added' else 'altered' end as change from documents where doc_id % 10 in (0, 1) or doc_id % 10 = 2",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    before = d.where("doc_id % 10 <> 1")
    after = d.where("doc_id % 10 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, F.lit("other")).otherwise(F.col("sha256")))
    return reconcile.changed_inputs(before, after, "doc_id")


@query(
    "verified_files",
    "select count(*) filter (doc_id % 7 > 1) as n_ok, count(*) filter (doc_id % 7 = 1) as n_different, 0::bigint as n_missing, count(*) filter (doc_id % 7 = 0) as n_unknown, sum(strlen(text))::bigint as n_bytes from documents where text is not null",
)
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("relative_path"), "doc_id", F.col("text").cast("binary").alias("content"))
    files = d.select("relative_path", "content", F.length("content").cast("bigint").alias("length"))
    recorded = d.where("doc_id % 7 <> 0").select("relative_path", F.when(F.col("doc_id") % 7 == 1, F.lit("0" * 64)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return fingerprint.verify_files(files, recorded)


# Scalars


@query(
    "text_forms",
    r"""with n as (select page_id, url, regexp_extract(url, '[^/]*$') as base from pages)
select page_id, substr(url, 1, 12) as short, regexp_replace(url, '[^0-9]', '', 'g') as digits, base as basename, lower(regexp_extract(base, '^.+(\.[^.]+)$', 1)) as suffix,
case when base like '_%.%' then regexp_replace(base, '(.)\.[^.]+$', '\1') else base end as stem, printf('%.6f', page_id / 8.0::double) as six, printf('%+.2f', page_id / 4.0::double - 3.0::double) as signed, md5(url) as md5,
regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') as component, printf('%016x', page_id) as hex from n""",
)
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", scalar.prefix(u, 12).alias("short"), scalar.digits(u).alias("digits"), scalar.basename(u).alias("basename"), scalar.suffix(u).alias("suffix"), scalar.stem(u).alias("stem"), scalar.fixed(F.col("page_id") / 8.0).alias("six"),
        scalar.fixed(F.col("page_id") / 4.0 - 3.0, 2, signed=True).alias("signed"), F.md5(u.cast("binary")).alias("md5"), scalar.safe_component(u).alias("component"), scalar.hex64("page_id").alias("hex"),
    )


@query(
    "number_forms",
    """select l_orderkey, l_linenumber, round_even(l_quantity / 4.0::double, 0) as even, l_quantity / 127.5::double - 1.0::double as scaled, isfinite(case when l_linenumber = 1 then 'nan'::double when l_linenumber = 2 then 'inf'::double else l_quantity end) as finite,
greatest(10.0::double, least(30.0::double, l_quantity)) as clipped, round(l_quantity * cos(radians(15.0::double)) - l_discount * sin(radians(15.0::double)), 9) as x, round(l_quantity * sin(radians(15.0::double)) + l_discount * cos(radians(15.0::double)), 9) as y from lineitem""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(q)
    point = scalar.rotated(q, F.col("l_discount"), 15.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar.half_even(q / 4.0).alias("even"), scalar.scaled_pixel(q).alias("scaled"), scalar.finite(odd).alias("finite"), scalar.clip(q, 10.0, 30.0).alias("clipped"), F.round(point["x"], 9).alias("x"), F.round(point["y"], 9).alias("y"))


@query("time_forms", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y%m%dT%H%M%SZ') as compact from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.utc_iso("ts").alias("iso"), scalar.utc_compact("ts").alias("compact"))


@query(
    "array_forms",
    """select vec_id, (list_min(embedding))::double as low, (list_max(embedding))::double as high, len(embedding)::int as width, ((embedding[1] > 0)::bigint * 4 + (embedding[2] > 0)::bigint * 2 + (embedding[3] > 0)::bigint)::bigint as bits,
[(label = 0)::int, (label = 1)::int, (label = 2)::int]::varchar as one_hot, list_concat([label, label + 1], [label + 2])::varchar as flat from embeddings""",
)
def _(spark, sf):
    e, label = F.col("embedding"), F.col("label")
    shown = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_min(e).cast("double").alias("low"), F.array_max(e).cast("double").alias("high"), F.size(e).alias("width"), scalar.packed_bits(F.transform(F.slice(e, 1, 3), lambda x: x > 0)).alias("bits"),
        shown(scalar.one_hot(label, [0, 1, 2])).alias("one_hot"), shown(F.flatten(F.array(F.array(label, label + 1), F.array(label + 2)))).alias("flat"),
    )


@query("open_map_rest", "select c_custkey, concat_ws(',', case when c_custkey % 2 = 0 then 'extra=' || c_custkey end, 'nation=' || c_nationkey) as rest from customer")
def _(spark, sf):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    even = F.create_map(F.lit("name"), F.lit("x"), F.lit("extra"), key, F.lit("nation"), nation)
    odd = F.create_map(F.lit("name"), F.lit("x"), F.lit("nation"), nation)
    rest = scalar.without_keys(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd), ["name", "path"])
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("rest"))


@query("counts_map", f"with {MANIFEST}, c as (select split, surface, count(*) as n from manifest group by all) select split, string_agg(surface || ':' || n, ',' order by surface) as counts from c group by split")
def _(spark, sf):
    c = manifests(spark, sf).groupBy("split", "surface").agg(F.count("*").alias("n"))
    made = c.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n")))).alias("m"))  # as long as the vocabulary
    return made.select("split", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("counts"))


@query("row_json", "select c_custkey, to_json({'key': c_custkey, 'nation': c_nationkey, 'segment': c_mktsegment})::varchar as json, sha256(to_json({'key': c_custkey, 'nation': c_nationkey, 'segment': c_mktsegment})::varchar) as digest from customer")
def _(spark, sf):
    json = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf, "customer").select("c_custkey", json.alias("json"), F.sha2(json.cast("binary"), 256).alias("digest"))


_TREES = ["artifacts/smoke/a.json", "x/Artifacts/SMOKE", "artifacts/report/b.csv", "artifacts/other/smoke", "a/../../b", "a/./../b", "/root/x", "smoke/artifacts"]


@query(
    "path_areas",
    f"with p as (select c_custkey, {_case_sql('c_custkey', _TREES)} as path from customer) select c_custkey, lower(path) in ('artifacts/smoke/a.json', 'x/artifacts/smoke') as is_smoke, path = 'artifacts/report/b.csv' as is_report, path not in ('a/../../b', '/root/x') as is_contained from p",
)
def _(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", _case("c_custkey", _TREES).alias("path"))
    return p.select("c_custkey", scalar.smoke_path("path").alias("is_smoke"), scalar.report_path("path").alias("is_report"), scalar.contained("path").alias("is_contained"))


@query(
    "difference_hash",
    """with g as (select c_custkey, [((c_custkey * 31 + (i // 9) * 7 + (i % 9) * 13) % 17)::int for i in range(72)] as g from customer)
select c_custkey, printf('%016x', list_sum([case when g[(i // 8) * 9 + i % 8 + 2] > g[(i // 8) * 9 + i % 8 + 1] then pow(2::hugeint, 63 - i)::hugeint else 0::hugeint end for i in range(64)])::ubigint) as dhash from g""",
)
def _(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: (F.col("c_custkey") * 31 + r * 7 + c * 13) % 17))
    return table(spark, sf, "customer").select("c_custkey", scalar.difference_hash(grid).alias("dhash"))


@query("close_values", "select l_orderkey, l_linenumber, abs(l_discount - (l_discount + l_tax * 1e-10::double)) <= greatest(1e-9::double * greatest(abs(l_discount), abs(l_discount + l_tax * 1e-10::double)), 1e-12::double) as is_close from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar.close("l_discount", F.col("l_discount") + F.col("l_tax") * 1e-10).alias("is_close"))


