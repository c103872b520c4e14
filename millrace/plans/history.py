"""Queries over run histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions import columns as C
from millrace.operators import history as H
from millrace.plans import bindings as B
from millrace.plans.bindings import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def last(metric: str) -> str:
    return f"SELECT tag, round(avg({metric}) FILTER (k<=5),6) AS last_mean, round(stddev_pop({metric}) FILTER (k<=5),6) AS last_std, round(stddev_pop({metric}),6) AS all_std FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY epoch DESC) AS k FROM history) GROUP BY tag"


BEST = "SELECT tag, arg_min(epoch, epoch) FILTER ({m}=best) AS best_epoch, max({m}) AS best FROM (SELECT *, max({m}) OVER (PARTITION BY tag) AS best FROM history) GROUP BY tag"
RUNNING = "SELECT tag, epoch, logo_auc, max(logo_auc) OVER w AS best_before, coalesce(logo_auc > max(logo_auc) OVER w, TRUE) AS improved FROM history WINDOW w AS (PARTITION BY tag ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SELECTED = "SELECT tag, epoch, logo_auc AS value FROM history QUALIFY row_number() OVER (PARTITION BY tag ORDER BY val_auc DESC, epoch)=1"
NAMED = "SELECT *, CASE WHEN feature_dim>0 THEN 'fusion' ELSE head END AS family, CASE WHEN frozen THEN 'frozen' ELSE 'unfrozen' END||'_'||CASE WHEN feature_dim>0 THEN 'fusion' ELSE head END||'_lr'||CASE WHEN lr<5e-4 THEN '1e-4' ELSE '1e-3' END AS variant FROM runs"
PAIRS = "SELECT f.frozen, f.tag AS fusion, m.tag AS control FROM n f JOIN n m ON f.frozen=m.frozen AND abs(f.lr-m.lr)<=1e-12 WHERE f.family='fusion' AND m.family='mlp'"


@query("w01_last_k", sql(last("logo_auc"), "history"))
def w01(spark, d):
    return H.last_k(B.history(spark, d), "logo_auc")


@query("w02_best_epoch", sql(BEST.format(m="logo_auc"), "history"))
def w02(spark, d):
    return H.best_epoch(B.history(spark, d), "logo_auc")


@query("w02_running_best", sql(RUNNING, "history"))
def w02_running(spark, d):
    return H.running_best(B.history(spark, d), "logo_auc").select("tag", "epoch", "logo_auc", "best_before", "improved")


@query("w03_early_stop", sql("SELECT tag, min(epoch) FILTER (bad>=4) AS stop_epoch FROM (SELECT *, row_number() OVER (PARTITION BY tag, island ORDER BY epoch)-1 AS bad FROM (SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY tag ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS island FROM r)) GROUP BY tag", "history", r=RUNNING))
def w03(spark, d):
    return H.early_stop(B.history(spark, d), "logo_auc", 4)


@query("w04_val_selected", sql(SELECTED, "history"))
def w04(spark, d):
    return H.selected(B.history(spark, d), "val_auc", "logo_auc")


@query("p19_variant_names", sql("SELECT tag, family, variant FROM n", "runs", n=NAMED))
def p19(spark, d):
    tags = B.history(spark, d).select("tag").distinct()
    return H.family(B.runs(spark)).join(tags, "tag").select("tag", "family", "variant")


@query("j09_fusion_control", sql(f"SELECT frozen, fusion, control, round(a.last_mean-b.last_mean,6) AS delta FROM p JOIN l a ON a.tag=fusion JOIN l b ON b.tag=control", "history", "runs", n=NAMED, p=PAIRS, l=last("logo_auc")))
def j09(spark, d):
    means = H.last_k(B.history(spark, d), "logo_auc").select("tag", "last_mean")
    of = lambda c, m: means.select(F.col("tag").alias(c), F.col("last_mean").alias(m))
    return H.fusion_pairs(B.runs(spark)).join(of("fusion", "a"), "fusion").join(of("control", "b"), "control").select("frozen", "fusion", "control", C.r6(F.col("a") - F.col("b")).alias("delta"))


TRADE = "SELECT frozen, fusion, control, round(va.last_mean-vb.last_mean,6) AS delta_val, round(la.last_mean-lb.last_mean,6) AS delta_logo FROM p JOIN v va ON va.tag=fusion JOIN v vb ON vb.tag=control JOIN l la ON la.tag=fusion JOIN l lb ON lb.tag=control"


def trade(spark, d):
    h = B.history(spark, d)
    means = H.last_k(h, "val_auc").select("tag", F.col("last_mean").alias("v")).join(H.last_k(h, "logo_auc").select("tag", F.col("last_mean").alias("l")), "tag")
    of = lambda c, n: means.select(F.col("tag").alias(c), F.col("v").alias(f"v{n}"), F.col("l").alias(f"l{n}"))
    j = H.fusion_pairs(B.runs(spark)).join(of("fusion", 1), "fusion").join(of("control", 2), "control")
    return j.select("frozen", "fusion", "control", C.r6(F.col("v1") - F.col("v2")).alias("delta_val"), C.r6(F.col("l1") - F.col("l2")).alias("delta_logo"))


@query("a14_cross_arm_delta", sql("SELECT fusion, 'val' AS distribution, delta_val AS delta FROM t UNION ALL SELECT fusion, 'logo', delta_logo FROM t", "history", "runs", n=NAMED, p=PAIRS, v=last("val_auc"), l=last("logo_auc"), t=TRADE))
def a14(spark, d):
    t = trade(spark, d)
    return t.select("fusion", F.explode(F.array(F.struct(F.lit("val").alias("distribution"), F.col("delta_val").alias("delta")), F.struct(F.lit("logo").alias("distribution"), F.col("delta_logo").alias("delta")))).alias("e")).select("fusion", "e.*")


@query("q3_distribution_tradeoff", sql(TRADE, "history", "runs", n=NAMED, p=PAIRS, v=last("val_auc"), l=last("logo_auc")))
def q3(spark, d):
    return trade(spark, d)


@query("q1_grid", sql("SELECT frozen, max(last_mean) FILTER (family='linear') AS linear, max(last_mean) FILTER (family='mlp') AS mlp, max(last_mean) FILTER (family='fusion') AS fusion, round(max(last_mean) FILTER (family='fusion')-max(last_mean) FILTER (family='mlp'),6) AS delta FROM n JOIN l USING (tag) GROUP BY frozen", "history", "runs", n=NAMED, l=last("logo_auc")))
def q1(spark, d):
    rows = H.family(B.runs(spark)).join(H.last_k(B.history(spark, d), "logo_auc"), "tag")
    grid = rows.groupBy("frozen").pivot("family", ["linear", "mlp", "fusion"]).agg(F.max("last_mean"))
    return grid.withColumn("delta", C.r6(F.col("fusion") - F.col("mlp")))


@query("q2_selection_sensitivity", sql("SELECT tag, last_mean, best, value AS val_selected FROM l JOIN b USING (tag) JOIN s USING (tag)", "history", l=last("logo_auc"), b=BEST.format(m="logo_auc"), s=SELECTED))
def q2(spark, d):
    h = B.history(spark, d)
    return H.last_k(h, "logo_auc").select("tag", "last_mean").join(H.best_epoch(h, "logo_auc").select("tag", "best"), "tag").join(H.selected(h, "val_auc", "logo_auc").select("tag", F.col("value").alias("val_selected")), "tag")


@query("q5_cost", sql("SELECT family, trainable_params, round(100.0::DOUBLE*trainable_params/total_params,6) AS percent FROM n JOIN (SELECT DISTINCT tag FROM history) USING (tag) QUALIFY row_number() OVER (PARTITION BY family ORDER BY tag)=1", "history", "runs", n=NAMED))
def q5(spark, d):
    rows = H.family(B.runs(spark)).join(B.history(spark, d).select("tag").distinct(), "tag")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("tag"))).where("k = 1")
    return first.select("family", "trainable_params", C.r6(100.0 * F.col("trainable_params") / F.col("total_params")).alias("percent"))


@query("p20_formatting", sql("SELECT tag, epoch, CASE WHEN epoch%7=0 THEN '—' ELSE printf('%.4f', logo_auc) END AS auc, printf('%d%%', CAST(round(val_auc*100) AS BIGINT)) AS pct FROM history", "history"))
def p20(spark, d):
    value = F.when(F.col("epoch") % 7 != 0, F.col("logo_auc"))
    return B.history(spark, d).select("tag", "epoch", F.when(value.isNull(), "—").otherwise(F.format_string("%.4f", value)).alias("auc"), F.format_string("%d%%", F.round(F.col("val_auc") * 100).cast("long")).alias("pct"))


MELT = "SELECT metric, baseline, model, round(model-baseline,6) AS delta FROM (SELECT 'last_mean' AS metric, a.last_mean AS baseline, b.last_mean AS model FROM l a, l b WHERE a.tag='view' AND b.tag='purchase' UNION ALL SELECT 'last_std', a.last_std, b.last_std FROM l a, l b WHERE a.tag='view' AND b.tag='purchase' UNION ALL SELECT 'all_std', a.all_std, b.all_std FROM l a, l b WHERE a.tag='view' AND b.tag='purchase')"


@query("a27_baseline_table", sql(MELT, "history", l=last("logo_auc")))
def a27(spark, d):
    m = H.last_k(B.history(spark, d), "logo_auc").unpivot("tag", ["last_mean", "last_std", "all_std"], "metric", "v")
    side = lambda t, n: m.where(F.col("tag") == t).select("metric", F.col("v").alias(n))
    return side("view", "baseline").join(side("purchase", "model"), "metric").withColumn("delta", C.r6(F.col("model") - F.col("baseline")))
