"""Queries over per-sample scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import history as H
from millrace.operators import scores as S
from millrace.plans import bindings as B
from millrace.plans.bindings import sql

MODELS = {"a": "p_a", "b": "p_b"}
KEYS = ["tag", "split"]
QUERIES, ORACLES = {}, {}

LONG = "SELECT 'a' AS tag, id, split, generator, y, p_a AS p FROM scores UNION ALL SELECT 'b', id, split, generator, y, p_b FROM scores"
COUNTS = "SELECT {keys}, count(*) FILTER (y=0 AND NOT p>={t}) AS tn, count(*) FILTER (y=0 AND p>={t}) AS fp, count(*) FILTER (y=1 AND NOT p>={t}) AS fn, count(*) FILTER (y=1 AND p>={t}) AS tp FROM {src} GROUP BY {keys}"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE)/nullif(CAST({b} AS DOUBLE),0),0.0::DOUBLE)"


_f1, _f0 = ratio("2*tp", "2*tp+fp+fn"), ratio("2*tn", "2*tn+fp+fn")
METRIC_SQL = {
    "accuracy": ratio("tp+tn", "tp+tn+fp+fn"), "balanced_accuracy": f"({ratio('tp', 'tp+fn')}+{ratio('tn', 'tn+fp')})/2", "precision_ai": ratio("tp", "tp+fp"), "recall_ai": ratio("tp", "tp+fn"), "f1_ai": _f1,
    "precision_real": ratio("tn", "tn+fn"), "recall_real": ratio("tn", "tn+fp"), "f1_real": _f0, "f1_macro": f"({_f1}+{_f0})/2",
    "mcc": f"coalesce((CAST(tp AS DOUBLE)*tn-CAST(fp AS DOUBLE)*fn)/nullif(sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)),0),0)", "fpr": ratio("fp", "fp+tn"), "fnr": ratio("fn", "fn+tp"),
}
METRICS = ", ".join(f"round({v},6) AS {k}" for k, v in METRIC_SQL.items())
HIST = "SELECT {keys}, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1-y) AS BIGINT) AS neg FROM {src} GROUP BY {keys}, p"
CUM = "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS np, sum(neg) OVER (PARTITION BY {keys}) AS nn FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
AUC = "round(sum(CAST(neg AS DOUBLE)*(tp-pos)+CAST(pos AS DOUBLE)*neg/2)/nullif(CAST(min(np) AS DOUBLE)*min(nn),0),6)"
AP = f"round(sum(pos*{ratio('tp', 'tp+fp')})/nullif(CAST(min(np) AS DOUBLE),0),6)"
BRIER = "round(CAST(sum(pos*(p-1)*(p-1)+neg*p*p) AS DOUBLE)/(min(np)+min(nn)),6)"
MAJORITY = "round(greatest(CAST(min(np) AS DOUBLE),CAST(min(nn) AS DOUBLE))/(min(np)+min(nn)),6)"
K = "tag, split"


def long_rows(spark: SparkSession, d: str, keep=("id", "split", "generator", "y")) -> DataFrame:
    return S.long_scores(B.scores(spark, d), MODELS, list(keep))


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def ranked(body: str, keys: str = K, src: str = "long", **more: str) -> str:
    return sql(body, "scores", long=LONG, hist=HIST.format(keys=keys, src=src), cum=CUM.format(keys=keys, src="hist"), **more)


COUNTED = COUNTS.format(keys=K, src="long", t="0.5::DOUBLE")


@query("a04_confusion", sql(f"SELECT *, round({ratio('tn', 'tn+fp')},6) AS tn_row, round({ratio('fp', 'tn+fp')},6) AS fp_row, round({ratio('fn', 'fn+tp')},6) AS fn_row, round({ratio('tp', 'fn+tp')},6) AS tp_row FROM c", "scores", long=LONG, c=COUNTED))
def a04(spark, d):
    c = S.confusion(long_rows(spark, d), KEYS)
    row = lambda a, x, y: C.r6(C.share(F.col(a), F.col(x) + F.col(y))).alias(f"{a}_row")
    return c.select("*", row("tn", "tn", "fp"), row("fp", "tn", "fp"), row("fn", "fn", "tp"), row("tp", "fn", "tp"))


@query("a05_threshold_metrics", sql(f"SELECT *, {METRICS} FROM c", "scores", long=LONG, c=COUNTED))
def a05(spark, d):
    return S.threshold_metrics(S.confusion(long_rows(spark, d), KEYS))


@query("a06_roc_auc", ranked(f"SELECT {K}, {AUC} AS auc FROM cum GROUP BY {K}"))
def a06(spark, d):
    return S.roc_auc(long_rows(spark, d), KEYS)


@query("a07_average_precision", ranked(f"SELECT {K}, {AP} AS ap FROM cum GROUP BY {K}"))
def a07(spark, d):
    return S.average_precision(long_rows(spark, d), KEYS)


@query("a08_brier", ranked(f"SELECT {K}, {BRIER} AS brier FROM cum GROUP BY {K}"))
def a08(spark, d):
    return S.ranking(long_rows(spark, d), KEYS).select(*KEYS, "brier")


@query("a09_majority_baseline", sql(f"SELECT {K}, round(greatest(avg(y),1-avg(y)),6) AS majority, count(DISTINCT p>=0.5::DOUBLE)=1 AS one_class FROM long GROUP BY {K}", "scores", long=LONG))
def a09(spark, d):
    ai = F.avg("y")
    return long_rows(spark, d).groupBy(*KEYS).agg(C.r6(F.greatest(ai, 1 - ai)).alias("majority"), (F.min(F.col("p") >= 0.5) == F.max(F.col("p") >= 0.5)).alias("one_class"))


BEST = f"SELECT {K}, p AS threshold, CAST(nn-fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(np-tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM cum QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY round({ratio('2*tp', 'tp+fp+np')},12) DESC, p)=1"


@query("a10_best_f1", ranked(f"SELECT *, {METRICS} FROM best", best=BEST))
def a10(spark, d):
    return S.threshold_metrics(S.best_f1(long_rows(spark, d), KEYS))


@query("a11_roc_points", ranked(f"SELECT {K}, p AS threshold, round({ratio('fp', 'nn')},6) AS fpr, round({ratio('tp', 'np')},6) AS tpr FROM cum UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM long"))
def a11_roc(spark, d):
    return S.roc_points(long_rows(spark, d), KEYS)


@query("a11_pr_points", ranked(f"SELECT {K}, p AS threshold, round({ratio('tp', 'tp+fp')},6) AS precision, round({ratio('tp', 'np')},6) AS recall FROM cum UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM long"))
def a11_pr(spark, d):
    return S.pr_points(long_rows(spark, d), KEYS)


@query("a12a_calibration_left", sql("SELECT tag, split, bin, count(*) AS n, round(avg(p),6) AS mean_p, round(avg(y),6) AS share_ai FROM (SELECT *, CAST(floor(p*12)+1 AS INT) AS bin FROM long) WHERE bin<=12 GROUP BY ALL HAVING count(*)>=40", "scores", long=LONG))
def a12a(spark, d):
    return S.calibration(long_rows(spark, d), KEYS, 12, 40, "left")


@query("a12b_calibration_right", sql("SELECT tag, split, bin, count(*) AS n, round(avg(p),6) AS mean_p, round(avg(y),6) AS share_ai FROM (SELECT *, CAST(greatest(ceil(p*10),1) AS INT) AS bin FROM long) WHERE bin<=10 GROUP BY ALL", "scores", long=LONG))
def a12b(spark, d):
    return S.calibration(long_rows(spark, d), KEYS, 10, 1, "right")


GROUPED = dict(
    f="SELECT tag, split, generator, count(*) AS n_fake FROM long WHERE y=1 GROUP BY ALL HAVING count(*)>=20",
    r="SELECT tag, split FROM long WHERE y=0 GROUP BY ALL HAVING count(*)>=20",
    hist="""SELECT tag, split, generator, p, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM (
        SELECT tag, split, generator, p, 1 AS pos, 0 AS neg FROM long WHERE y=1 UNION ALL SELECT f.tag, f.split, f.generator, l.p, 0, 1 FROM long l JOIN f ON l.tag=f.tag AND l.split=f.split WHERE l.y=0) GROUP BY ALL""",
    cum=CUM.format(keys="tag, split, generator", src="hist"),
)
PER_GROUP = f"SELECT c.tag, c.split, c.generator, {AUC} AS auc, {AP} AS ap, min(f.n_fake) AS n_fake FROM cum c JOIN f USING (tag, split, generator) JOIN r USING (tag, split) GROUP BY c.tag, c.split, c.generator"


@query("a13_per_generator_auc", sql(PER_GROUP, "scores", long=LONG, **GROUPED))
def a13(spark, d):
    return S.per_group_auc(long_rows(spark, d), KEYS).select("tag", "split", "generator", "auc", "ap", "n_fake")


@query("j11_group_against_shared_pool", sql(f"SELECT generator, auc, ap, n_fake FROM ({PER_GROUP}) WHERE tag='a' AND split='logo'", "scores", long=LONG, **GROUPED))
def j11(spark, d):
    return S.per_group_auc(long_rows(spark, d).where("tag = 'a' and split = 'logo'"), KEYS).select("generator", "auc", "ap", "n_fake")


DELTA = "SELECT a.generator, a.n_fake, a.auc AS auc_a, b.auc AS auc_b, round(b.auc-a.auc,6) AS delta FROM (SELECT * FROM g WHERE tag='a' AND split='logo' AND n_fake>={least}) a LEFT JOIN (SELECT * FROM g WHERE tag='b' AND split='logo') b USING (generator)"


def deltas(g: DataFrame, least: int) -> DataFrame:
    a = g.where(f"tag = 'a' and split = 'logo' and n_fake >= {least}").select("generator", "n_fake", F.col("auc").alias("auc_a"))
    b = g.where("tag = 'b' and split = 'logo'").select("generator", F.col("auc").alias("auc_b"))
    return a.join(b, "generator", "left").withColumn("delta", C.r6(F.col("auc_b") - F.col("auc_a")))


@query("j10_generator_delta", sql(DELTA.format(least=60), "scores", long=LONG, **GROUPED, g=PER_GROUP))
def j10(spark, d):
    return deltas(S.per_group_auc(long_rows(spark, d), KEYS), 60)


@query("q6_held_out_generators", sql(DELTA.format(least=20), "scores", long=LONG, **GROUPED, g=PER_GROUP))
def q6(spark, d):
    return deltas(S.per_group_auc(long_rows(spark, d), KEYS), 20)


@query("a15_probability_summary", sql("SELECT tag, generator, count(p) AS n, round(coalesce(avg(p),0),6) AS mean, round(coalesce(stddev_pop(p),0),6) AS std, round(coalesce(median(p),0),6) AS median, round(coalesce(min(p),0),6) AS low, round(coalesce(max(p),0),6) AS high, round(coalesce(avg(CASE WHEN p>0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END),0),6) AS share_ai FROM long GROUP BY ALL", "scores", long=LONG))
def a15(spark, d):
    return S.probability_summary(long_rows(spark, d), ["tag", "generator"])


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = B.scores(spark, d)
    pred = (F.col("p_a") >= 0.5).cast("int")
    conf = F.greatest("p_a", 1 - F.col("p_a"))
    return s.select("id", "split", "generator", "y", F.col("p_a").alias("p"), pred.alias("pred"), conf.alias("confidence"), C.error_type(F.col("y"), pred).alias("error_type"), C.class_name(pred).alias("predicted"), C.confidence_bucket(conf).alias("bucket"))


OUT = """SELECT id, split, generator, y, p_a AS p, CASE WHEN p_a>=0.5::DOUBLE THEN 1 ELSE 0 END AS pred, greatest(p_a,1-p_a) AS confidence,
 CASE WHEN y=CASE WHEN p_a>=0.5::DOUBLE THEN 1 ELSE 0 END THEN 'correct' WHEN y=0 THEN 'false_positive' ELSE 'false_negative' END AS error_type,
 CASE WHEN p_a>=0.5::DOUBLE THEN 'AI-Generated' ELSE 'Real' END AS predicted, CASE WHEN greatest(p_a,1-p_a)>=0.8::DOUBLE THEN 'high' ELSE 'low' END AS bucket FROM scores"""


@query("p11_outcomes", sql("SELECT id, y, pred, error_type, predicted, bucket, round(confidence,6) AS confidence FROM o", "scores", o=OUT))
def p11(spark, d):
    return outcomes(spark, d).select("id", "y", "pred", "error_type", "predicted", "bucket", C.r6(F.col("confidence")).alias("confidence"))


@query("p12_decision_columns", sql("""SELECT event_id AS id, p>=0.5::DOUBLE AS positive, round(greatest(p,1-p),6) AS confidence, round(2*abs(p-0.5::DOUBLE),6) AS margin, (p>=0.5::DOUBLE)<>(y=1) AS misclassified
 FROM (SELECT event_id, CASE WHEN value>=60 THEN 1 ELSE 0 END AS y, coalesce(TRY_CAST(CASE WHEN event_id%11=0 THEN 'n/a' WHEN event_id%13=0 THEN NULL ELSE CAST(least(value,100)/100.0::DOUBLE AS VARCHAR) END AS DOUBLE),0.5::DOUBLE) AS p FROM events)"""))
def p12(spark, d):
    raw = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise((F.least("value", F.lit(100.0)) / 100.0).cast("string"))
    e = B.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") >= 60).alias("y"), F.coalesce(raw.try_cast("double"), F.lit(0.5)).alias("p"))
    p = F.col("p")
    return e.select("id", (p >= 0.5).alias("positive"), C.r6(F.greatest(p, 1 - p)).alias("confidence"), C.r6(2 * F.abs(p - 0.5)).alias("margin"), ((p >= 0.5) != F.col("y")).alias("misclassified"))


@query("p13_softmax", """SELECT vec_id, round(exp(a-m)/(exp(a-m)+exp(b-m)),6) AS p0, round(exp(b-m)/(exp(a-m)+exp(b-m)),6) AS p1, CASE WHEN a>=b THEN 0 ELSE 1 END AS pred, round(greatest(exp(a-m),exp(b-m))/(exp(a-m)+exp(b-m)),6) AS confidence
 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, greatest(CAST(embedding[1] AS DOUBLE),CAST(embedding[2] AS DOUBLE)) AS m FROM embeddings)""")
def p13(spark, d):
    logits = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    e = B.read(spark, d, "embeddings").select("vec_id", C.softmax(logits).alias("p"))
    best = F.array_max("p")
    return e.select("vec_id", C.r6(F.get("p", F.lit(0))).alias("p0"), C.r6(F.get("p", F.lit(1))).alias("p1"), (F.array_position("p", best) - 1).cast("int").alias("pred"), C.r6(best).alias("confidence"))


@query("a21_error_breakdown", sql("SELECT error_type, bucket, count(*) AS n FROM o GROUP BY ALL ORDER BY 1,2", "scores", o=OUT))
def a21(spark, d):
    return outcomes(spark, d).groupBy("error_type", "bucket").agg(F.count("*").alias("n")).orderBy("error_type", "bucket")


@query("w12_first_of_each_outcome", sql("SELECT id, correct, k FROM (SELECT id, error_type='correct' AS correct, row_number() OVER (PARTITION BY error_type='correct' ORDER BY id) AS k FROM o) WHERE k<=CASE WHEN correct THEN 20 ELSE 5 END", "scores", o=OUT))
def w12(spark, d):
    o = outcomes(spark, d).withColumn("correct", F.col("error_type") == "correct")
    k = F.row_number().over(Window.partitionBy("correct").orderBy("id"))
    return o.select("id", "correct", k.alias("k")).where(F.col("k") <= F.when(F.col("correct"), 20).otherwise(5))


@query("u2_error_overlap", sql("SELECT name, CASE WHEN ea AND eb THEN 'both' WHEN ea THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT DISTINCT 'img'||(id%5000) AS name, bool_or(y<>CASE WHEN p_a>=0.5::DOUBLE THEN 1 ELSE 0 END) AS ea, bool_or(y<>CASE WHEN p_b>=0.5::DOUBLE THEN 1 ELSE 0 END) AS eb FROM scores GROUP BY 1) WHERE ea OR eb", "scores"))
def u2(spark, d):
    s = B.scores(spark, d).withColumn("name", F.concat(F.lit("img"), (F.col("id") % 5000).cast("string")))
    wrong = lambda c: s.where(F.col("y") != (F.col(c) >= 0.5).cast("int")).select("name").distinct()
    a, b = wrong("p_a"), wrong("p_b")
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "only_a")).unionByName(side(b.subtract(a), "only_b"))


@query("t2_ordered_predictions", sql("SELECT id, error_type, round(confidence,6) AS confidence FROM o ORDER BY error_type, confidence DESC, id", "scores", o=OUT))
def t2(spark, d):
    return outcomes(spark, d).orderBy("error_type", F.desc("confidence"), "id").select("id", "error_type", C.r6(F.col("confidence")).alias("confidence"))


@query("t3_leaderboard", ranked(f"SELECT {K}, {AUC} AS auc FROM cum GROUP BY {K} ORDER BY coalesce(auc,0) DESC, tag, split"))
def t3(spark, d):
    return S.roc_auc(long_rows(spark, d), KEYS).orderBy(F.desc(F.coalesce("auc", F.lit(0.0))), "tag", "split")


Q4 = """SELECT v.tag, v.acc AS accuracy_val, l.acc AS accuracy_logo, b.threshold AS threshold_logo, b.accuracy AS accuracy_best, b.recall_ai AS recall_best FROM (SELECT tag, accuracy AS acc FROM m WHERE split='val') v
 JOIN (SELECT tag, accuracy AS acc FROM m WHERE split='logo') l USING (tag) JOIN (SELECT * FROM bm WHERE split='logo') b USING (tag)"""


@query("q4_threshold_transfer", ranked(Q4, c=COUNTED, m=f"SELECT *, {METRICS} FROM c", best=BEST, bm=f"SELECT *, {METRICS} FROM best"))
def q4(spark, d):
    rows = long_rows(spark, d)
    at = S.threshold_metrics(S.confusion(rows, KEYS))
    best = S.threshold_metrics(S.best_f1(rows.where("split = 'logo'"), KEYS))
    pick = lambda s: at.where(F.col("split") == s).select("tag", F.col("accuracy").alias(f"accuracy_{s}"))
    return pick("val").join(pick("logo"), "tag").join(best.select("tag", F.col("threshold").alias("threshold_logo"), F.col("accuracy").alias("accuracy_best"), F.col("recall_ai").alias("recall_best")), "tag")


#: Whose history goes with whose scores.
RUN_OF = {"a": "click", "b": "view"}
SELECTION = f"""SELECT CASE tag {' '.join(f"WHEN '{r}' THEN '{m}'" for m, r in RUN_OF.items())} END AS tag, max(logo_auc) AS best_logo, min(epoch) FILTER (r_logo=1) AS best_logo_epoch, max(logo_auc) FILTER (k=1) AS final_logo, round(avg(logo_auc) FILTER (k<=5),6) AS last5_mean,
 round(stddev_pop(logo_auc) FILTER (k<=5),6) AS last5_sd, round(stddev_pop(logo_auc),6) AS all_sd, min(epoch) FILTER (r_val=1) AS val_selected_epoch, max(logo_auc) FILTER (r_val=1) AS val_selected_logo, max(val_auc) AS val_selected_val
 FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY epoch DESC) AS k, row_number() OVER (PARTITION BY tag ORDER BY logo_auc DESC, epoch) AS r_logo, row_number() OVER (PARTITION BY tag ORDER BY val_auc DESC, epoch) AS r_val FROM history) WHERE tag IN ({', '.join(f"'{r}'" for r in RUN_OF.values())}) GROUP BY tag"""
SELECTED = ["best_logo", "best_logo_epoch", "final_logo", "last5_mean", "last5_sd", "all_sd", "val_selected_epoch", "val_selected_logo", "val_selected_val"]


@query("q7_metric_table", ranked(f"SELECT r.*, {', '.join('m.' + k for k in METRIC_SQL)}, m.tn, m.fp, m.fn, m.tp, {', '.join('s.' + c for c in SELECTED)} FROM (SELECT {K}, {AUC} AS auc, {AP} AS ap, {BRIER} AS brier, {MAJORITY} AS majority, CAST(min(np)+min(nn) AS BIGINT) AS n FROM cum GROUP BY {K}) r JOIN m USING ({K}) LEFT JOIN se s ON s.tag=r.tag AND r.split='logo'", c=COUNTED, m=f"SELECT *, {METRICS} FROM c", history=B.CTE["history"], se=SELECTION))
def q7(spark, d):
    """All metrics by model and split; held-out rows also have what their run's history selects."""
    rows = long_rows(spark, d)
    table = S.ranking(rows, KEYS).select(*KEYS, "auc", "ap", "brier", "majority", "n").join(S.threshold_metrics(S.confusion(rows, KEYS)), KEYS)
    names = F.create_map(*[F.lit(x) for m, r in RUN_OF.items() for x in (r, m)])
    stats = H.selection_stats(B.history(spark, d), "val_auc", "logo_auc").withColumn("tag", names[F.col("tag")]).where("tag is not null").withColumn("split", F.lit("logo"))
    return table.join(stats, KEYS, "left")
