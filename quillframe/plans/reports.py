"""Rankings, findings and comparisons of runs and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.geometry import ratio
from quillframe.plans.scoring import COUNTS, SUMMED_SQL, facts, r6, sums
from quillframe.plans.tables import Tables, query

LATEST_SQL = ", latest as (select * from (select *, row_number() over (partition by dataset, model order by run_id desc) as n from runs) where n = 1)"


def latest(t: Tables) -> DataFrame:
    """The newest run of each model on each dataset: an aggregate, so that a model with any number of runs needs no sort."""
    return t.runs.groupBy("dataset", "model").agg(F.max_by(F.struct("run_id", "value", "pages"), "run_id").alias("x")).select("dataset", "model", "x.*")


@query(LATEST_SQL + " select dataset, model, run_id, value, cast(pages as bigint) as pages from latest")
def latest_run_per_model(t: Tables) -> DataFrame:
    return latest(t)


@query(LATEST_SQL + " select dataset, model, rank() over (partition by dataset order by value) as rank, value = min(value) over (partition by dataset) as best from latest where value is not null")
def metric_rank(t: Tables) -> DataFrame:
    """1 + the number of strictly better models; less is better. A dataset has as many rows as there are models."""
    w = Window.partitionBy("dataset")
    return latest(t).where("value is not null").select("dataset", "model", F.rank().over(w.orderBy("value")).alias("rank"), (F.col("value") == F.min("value").over(w)).alias("best"))


@query(LATEST_SQL + " select model, case when length(model) % 2 = 0 then value end as label_acc, case when length(model) > 4 then cast(pages as double) end as deco_f1, dataset from latest")
def mask_unsupported_metrics(t: Tables) -> DataFrame:
    outputs = F.concat(F.when(F.length("model") % 2 == 0, F.array(F.lit("label"))).otherwise(F.array().cast("array<string>")), F.when(F.length("model") > 4, F.array(F.lit("runs"))).otherwise(F.array().cast("array<string>")))
    x = latest(t).withColumn("outputs", outputs)
    return x.select("dataset", "model", F.when(F.array_contains("outputs", "label"), F.col("value")).alias("label_acc"), F.when(F.array_contains("outputs", "runs"), F.col("pages").cast("double")).alias("deco_f1"))


@query("select model, count(*) as n, round(sum(value) / nullif(sum(pages), 0), 4) as sec_per_page from runs group by model")
def sec_per_page(t: Tables) -> DataFrame:
    return t.runs.groupBy("model").agg(F.count("*").alias("n"), F.round(ratio(F.sum("value"), F.sum("pages")), 4).alias("sec_per_page"))


@query("select setting, cast(sum(errors) as bigint) as errors, cast(sum(chars) as bigint) as chars, round(sum(errors) / sum(chars), 6) as cer, row_number() over (order by sum(errors) / sum(chars) nulls last, setting) as place from grid group by setting")
def compare_table(t: Tables) -> DataFrame:
    """Settings by micro error rate; there are a handful."""
    s = t.grid.groupBy("setting").agg(F.sum("errors").alias("errors"), F.sum("chars").alias("chars")).withColumn("rate", ratio(F.col("errors"), F.col("chars")))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("rate"), "setting"))
    return s.select("setting", "errors", "chars", r6(F.col("rate"), "cer"), place.alias("place"))


@query("""
, s as (select case_id % 3 as dataset, setting, sum(errors) / sum(chars) as rate from grid group by 1, 2)
select dataset, arg_min(setting, (rate, setting)) as setting, round(min(rate), 6) as cer from s group by dataset""")
def best_preset_per_dataset(t: Tables) -> DataFrame:
    s = t.grid.groupBy((F.col("case_id") % 3).alias("dataset"), "setting").agg(ratio(F.sum("errors"), F.sum("chars")).alias("rate"))
    return s.groupBy("dataset").agg(F.min_by("setting", F.struct("rate", "setting")).alias("setting"), r6(F.min("rate"), "cer"))


@query("""
, s as (select setting, sum(errors) as e, sum(chars) as c from grid group by setting), b as (select arg_min(setting, (e / c, setting)) as setting from s),
o as (select case_id, arg_min(struct_pack(e := errors, c := chars), (errors / chars, setting)) as x from grid group by case_id), single as (select sum(e) / sum(c) as r from s where setting = (select setting from b)), best as (select sum(x.e) / sum(x.c) as r from o), mean as (select sum(e) / sum(c) as r from s)
select (select setting from b) as setting, round(single.r, 6) as single_best, round(best.r, 6) as oracle, round(mean.r, 6) as overall, round((single.r - mean.r) / nullif(single.r - best.r, 0), 6) as gap_closed from single, best, mean""")
def oracle_vs_single_best(t: Tables) -> DataFrame:
    """The best setting overall against the best of each case; the gap that the mean of all settings would close."""
    c = F.col
    s = t.grid.groupBy("setting").agg(F.sum("errors").alias("e"), F.sum("chars").alias("c")).withColumn("rate", ratio(c("e"), c("c")))
    single = s.agg(F.min_by("setting", F.struct("rate", "setting")).alias("setting"), F.min("rate").alias("single"), ratio(F.sum("e"), F.sum("c")).alias("mean"))
    per = t.grid.groupBy("case_id").agg(F.min_by(F.struct("errors", "chars"), F.struct(ratio(c("errors"), c("chars")).alias("r"), "setting")).alias("x"))
    best = per.agg(ratio(F.sum("x.errors"), F.sum("x.chars")).alias("best"))
    both = single.join(F.broadcast(best))
    return both.select("setting", r6(c("single"), "single_best"), r6(c("best"), "oracle"), r6(c("mean"), "overall"), r6(ratio(c("single") - c("mean"), c("single") - c("best")), "gap_closed"))


FINDINGS_SQL = f"""
, {SUMMED_SQL}, s as (select 'lang=' || lang as tag, count(distinct doc_id) as k, sum(n_pairs) as np, sum(n_gt) as ng, sum(label_ok) as ok from facts group by lang union all select 'source=' || source, count(distinct doc_id), sum(n_pairs), sum(n_gt), sum(label_ok) from facts group by source),
w as (select sum(n_pairs) / nullif(sum(n_gt), 0) as recall, sum(label_ok) / nullif(sum(n_pairs), 0) as acc from facts),
d as (select tag, 'recall' as metric, np / nullif(ng, 0) - w.recall as diff from s, w where k >= 5 union all select tag, 'label_acc', ok / nullif(np, 0) - w.acc from s, w where k >= 5)
select tag, metric, round(diff, 6) as diff from d where abs(diff) >= 0.005 order by abs(round(diff, 9)) desc, tag, metric limit 12"""


@query(FINDINGS_SQL)
def findings_topk(t: Tables) -> DataFrame:
    """The twelve slices, of at least five cases, that differ most from the whole."""
    c = F.col
    f = facts(t).select(F.explode(F.array(F.lit("all"), F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"))).alias("tag"), "doc_id", *COUNTS)
    # By document first: a case counts once however many pages it has.
    f = f.groupBy("tag", "doc_id").agg(*sums())
    s = f.groupBy("tag").agg(F.count("*").alias("k"), *sums())
    m = s.select("tag", "k", F.explode(F.array(F.struct(F.lit("recall").alias("metric"), ratio(c("n_pairs"), c("n_gt")).alias("value")), F.struct(F.lit("label_acc").alias("metric"), ratio(c("label_ok"), c("n_pairs")).alias("value")))).alias("m")).select("tag", "k", "m.*")
    whole = m.where("tag = 'all'").select("metric", c("value").alias("whole"))
    d = m.where("tag <> 'all' and k >= 5").join(F.broadcast(whole), "metric").withColumn("diff", c("value") - c("whole")).where("abs(diff) >= 0.005")
    return d.orderBy(F.desc(F.abs(F.round("diff", 9))), "tag", "metric").limit(12).select("tag", "metric", r6(c("diff"), "diff"))


@query()
def standardise_features(t: Tables) -> DataFrame:
    """Every vector less the means, over the population deviations (1 if under 1e-6) of the training fold's columns; tests compare with numpy."""
    e = t.table("embeddings").select("vec_id", "label", "embedding")
    x = e.where("vec_id % 5 <> 0").select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    s = x.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    s = s.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("mean", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")).alias("std"))))).alias("s"))
    scaled = F.transform("embedding", lambda x, i: F.round((x.cast("double") - F.col("s")[i]["mean"]) / F.col("s")[i]["std"], 6))
    return e.crossJoin(F.broadcast(s)).select("vec_id", "label", scaled.alias("features"))


@query("""
, b as (select case when n_chars < 500 then 'short' when n_chars < 2000 then 'middle' else 'long' end as bucket, quality from documents join labels using (doc_id) where n_chars is not null)
select bucket, count(*) as n, round(avg(quality), 6) as accuracy from b group by bucket""")
def length_bucket_accuracy(t: Tables) -> DataFrame:
    b = t.table("documents").where("n_chars is not null").select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long").alias("bucket"))
    return b.join(t.table("labels").select("doc_id", "quality"), "doc_id").groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("quality"), "accuracy"))
