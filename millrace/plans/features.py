"""Queries over feature tables and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import features as X
from millrace.operators import gates as G
from millrace.operators.splits import require_coverage
from millrace.plans import bindings as B
from millrace.plans.bindings import FEATURES, sql

QUERIES, ORACLES = {}, {}
TRAIN = "doc_id % 5 > 1"
SIGNALS = {"fft_irregularity": ["f_chars", "f_words"], "prnu_variation": ["f_digits"], "lab_saturation": ["f_upper", "f_lines"]}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def floor_sql(c: str, floor: str) -> str:
    return f"CASE WHEN stddev_pop({c})<{floor} THEN 1.0::DOUBLE ELSE stddev_pop({c}) END"


def scaler_sql(floor: str, where: str = "TRUE") -> str:
    return "SELECT " + ", ".join([f"avg({c}) AS mu_{c}" for c in FEATURES] + [f"{floor_sql(c, floor)} AS sd_{c}" for c in FEATURES]) + f" FROM features WHERE {where}"


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n},6) AS {n}" for n in names)


MOMENTS = [f"{m}_{c}" for c in FEATURES for m in ("mu", "sd")]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[C.r6(F.col(c)).alias(c) for c in MOMENTS])


@query("a16a_scaler_whole", sql(f"SELECT {rounded(MOMENTS)} FROM s", "features", s=scaler_sql("1e-6")))
def a16a(spark, d):
    return shown(X.fit_scaler(B.features(spark, d), FEATURES))


@query("a16b_scaler_train", sql(f"SELECT {rounded(MOMENTS)} FROM s", "features", s=scaler_sql("1e-6", "doc_id%5>1")))
def a16b(spark, d):
    return shown(X.fit_scaler(B.features(spark, d).where(TRAIN), FEATURES))


Z = ", ".join(f"round(greatest(-10.0::DOUBLE,least(10.0::DOUBLE,({c}-mu_{c})/sd_{c})),6) AS {c}" for c in FEATURES)


@query("p17_standardize_clip", sql(f"SELECT uid, label, {Z} FROM features, s", "features", s=scaler_sql("1e-8", "doc_id%5>1")))
def p17(spark, d):
    f = B.features(spark, d)
    return X.standardized(f.drop("doc_id"), X.fit_scaler(f.where(TRAIN), FEATURES, 1e-8), FEATURES, 10.0)


@query("p16_sanitize", "SELECT event_id, CASE WHEN event_id%4=1 OR event_id%4=2 OR event_id%4=3 THEN 0.0::DOUBLE ELSE value END AS v, CASE WHEN event_id%6=0 THEN NULL ELSE value END AS parsed FROM events")
def p16(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("value")).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf")))
    text = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return B.read(spark, d, "events").select("event_id", C.sanitized(raw).alias("v"), text.try_cast("double").alias("parsed"))


QUART = ", ".join(f"round(quantile_cont(v,{q}),6) AS {n}" for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")))
LONGF = " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS v FROM features" for c in FEATURES)


@query("a17_describe", sql(f"SELECT feature, count(v) AS n, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std, min(v) AS low, {QUART}, max(v) AS high FROM long GROUP BY feature", "features", long=LONGF))
def a17(spark, d):
    return X.described(B.features(spark, d), FEATURES)


@query("a18_class_histograms", sql("SELECT feature, label, CAST(CASE WHEN hi>lo THEN least(20,floor((v-lo)*20/(hi-lo))+1) ELSE 1 END AS INT) AS bin, count(*) AS n FROM long JOIN (SELECT feature, label, min(v) AS lo, max(v) AS hi FROM long GROUP BY ALL) USING (feature, label) GROUP BY ALL", "features", long=LONGF))
def a18(spark, d):
    return X.class_histograms(B.features(spark, d), FEATURES, 20)


CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM features" for a in FEATURES for b in FEATURES)


@query("a19_correlations", sql(CORR, "features"))
def a19(spark, d):
    return X.correlations(B.features(spark, d), FEATURES)


@query("t1_top_correlated", sql(f"SELECT b AS feature, r FROM ({CORR}) WHERE a='f_chars' AND b<>'f_chars' ORDER BY abs(r) DESC, b LIMIT 3", "features"))
def t1(spark, d):
    r = X.correlations(B.features(spark, d), FEATURES).where("a = 'f_chars' and b <> 'f_chars'")
    return r.orderBy(F.desc(F.abs("r")), "b").limit(3).select(F.col("b").alias("feature"), "r")


def z_sql(c: str) -> str:
    return f"CASE WHEN sd_{c}<1e-6 THEN CASE WHEN abs({c}-mu_{c})<1e-6 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END ELSE abs({c}-mu_{c})/sd_{c} END"


RAW = "SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATURES) + " FROM features"
ZS = "SELECT f.*, " + ", ".join(f"(0.0::DOUBLE+{'+'.join(z_sql(c) for c in cs)})/{len(cs)} AS z_{n}" for n, cs in SIGNALS.items()) + " FROM features f, m"
BUCKETS = "SELECT *, " + ", ".join(f"round(least(greatest(z_{n}/3.0::DOUBLE,0.0::DOUBLE),1.0::DOUBLE),4) AS s_{n}, CASE WHEN z_{n}>=2 THEN 'high' WHEN z_{n}>=1 THEN 'medium' ELSE 'low' END AS l_{n}" for n in SIGNALS) + " FROM z"
SIGNAL = dict(m=RAW, z=ZS, b=BUCKETS)


@query("a23_mean_abs_z", sql("SELECT uid, " + rounded([f"z_{n}" for n in SIGNALS]) + " FROM z", "features", m=RAW, z=ZS))
def a23(spark, d):
    f = B.features(spark, d)
    wide = f.crossJoin(F.broadcast(X.raw_moments(f, FEATURES)))
    return wide.select("uid", *[C.r6(X.mean_abs_z(None, cs)).alias(f"z_{n}") for n, cs in SIGNALS.items()])


CHAIN, RAW_SHARE = [["f_upper", "f_lines"], ["f_words"]], ("f_share",)


@query("a23_fallback_chain", sql(f"SELECT uid, round(({z_sql('f_upper')}+{z_sql('f_lines')})/2,6) AS z_whole, round({z_sql('f_lines')},6) AS z_part, round({z_sql('f_words')},6) AS z_second, round(f_upper/f_chars*3,6) AS z_raw, 0.0::DOUBLE AS z_none FROM features, m", "features", m=RAW))
def a23_chain(spark, d):
    """The third signal from tables that lack some of its columns: all there, one missing, the first choice missing, both choices missing, nothing at all."""
    f = B.features(spark, d).withColumn("f_share", F.try_divide("f_upper", "f_chars"))
    wide = f.crossJoin(F.broadcast(X.raw_moments(f, FEATURES)))
    lacks = {"z_whole": [], "z_part": ["f_upper"], "z_second": ["f_upper", "f_lines"], "z_raw": ["f_upper", "f_lines", "f_words"], "z_none": ["f_upper", "f_lines", "f_words", "f_share"]}
    return wide.select("uid", *[C.r6(X.signal_z(wide.drop(*gone), CHAIN, RAW_SHARE)).alias(n) for n, gone in lacks.items()])


@query("p14_signal_buckets", sql("SELECT uid, " + ", ".join(f"s_{n}, l_{n}" for n in SIGNALS) + " FROM b", "features", **SIGNAL))
def p14(spark, d):
    f = B.features(spark, d)
    s = X.with_signals(f, X.raw_moments(f, FEATURES), SIGNALS)
    return s.select("uid", *[F.col(f"{n}.score").alias(f"s_{n}") for n in SIGNALS], *[F.col(f"{n}.label").alias(f"l_{n}") for n in SIGNALS])


def report(spark, d, mode: str) -> DataFrame:
    f = B.features(spark, d)
    s = X.with_signals(f, X.raw_moments(f, FEATURES), SIGNALS)
    conf = F.floor(F.col("doc_id") * 7919 % 1000) / 1000.0
    name = F.when(F.col("doc_id") % 2 == 0, "AI-Generated").otherwise("Real")
    predicted = F.when(F.contains(F.lower(F.trim(name)), F.lit("ai")), 1).otherwise(0)
    ai = conf if mode == "ai_probability" else F.when(predicted == 1, conf).otherwise(1 - conf)
    own = F.when(predicted == 1, ai).otherwise(1 - ai)
    return s.select("uid", predicted.alias("predicted"), F.round(ai, 4).alias("ai_probability"), F.round(own, 4).alias("confidence"), X.verdict(predicted, ai, list(SIGNALS)).alias("verdict"))


HIGH = "+".join(f"CAST(l_{n}='high' AS INT)" for n in SIGNALS)
RAISED = "+".join(f"CAST(l_{n}<>'low' AS INT)" for n in SIGNALS)
MEAN = "(" + "+".join(f"s_{n}" for n in SIGNALS) + ")/3"


def report_sql(mode: str) -> str:
    ai = "c" if mode == "ai_probability" else "CASE WHEN p=1 THEN c ELSE 1-c END"
    a, r = X.AI_VERDICTS, X.REAL_VERDICTS
    body = f"""SELECT uid, p AS predicted, round(ai,4) AS ai_probability, round(CASE WHEN p=1 THEN ai ELSE 1-ai END,4) AS confidence,
     CASE WHEN p=1 THEN CASE WHEN ai>=0.85::DOUBLE AND {HIGH}>=2 THEN '{a[0]}' WHEN ai>=0.65::DOUBLE OR {RAISED}>=2 THEN '{a[1]}' ELSE '{a[2]}' END
     ELSE CASE WHEN ai<=0.15::DOUBLE AND {HIGH}=0 AND {MEAN}<0.35::DOUBLE THEN '{r[0]}' WHEN ai<=0.35::DOUBLE AND {HIGH}<=1 THEN '{r[1]}' ELSE '{r[2]}' END END AS verdict
     FROM (SELECT *, {ai} AS ai FROM (SELECT *, CAST(doc_id*7919%1000 AS DOUBLE)/1000.0::DOUBLE AS c, CASE WHEN doc_id%2=0 THEN 1 ELSE 0 END AS p FROM b))"""
    return sql(body, "features", **SIGNAL)


@query("p15_report_predicted_class", report_sql("predicted_class"))
def p15(spark, d):
    return report(spark, d, "predicted_class")


@query("r11_report_ai_probability", report_sql("ai_probability"))
def r11(spark, d):
    return report(spark, d, "ai_probability")


HAVE = "SELECT * FROM features WHERE doc_id IN (SELECT doc_id FROM labels)"


def covered(spark, d) -> DataFrame:
    """The features at hand: those of labelled documents."""
    return B.features(spark, d).join(B.read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("j01_features_by_manifest", sql("SELECT c.uid, c.label, f_chars FROM corpus c JOIN have USING (uid)", "corpus", "features", have=HAVE))
def j01(spark, d):
    return B.corpus(spark, d).select("uid", "label").join(covered(spark, d).select("uid", "f_chars"), "uid")


@query("j02_payload_by_uid", sql("SELECT c.uid, c.generator, length(d.text) AS size FROM (SELECT * FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1)) c JOIN documents d USING (doc_id)", "corpus"))
def j02(spark, d):
    wanted = B.corpus(spark, d).join(B.read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "uid", "generator")
    return wanted.join(B.read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("uid", "generator", F.length("text").alias("size"))


@query("j03_uid_list", sql("SELECT uid, f_words FROM features WHERE uid IN (SELECT uid FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic=0))", "corpus", "features"))
def j03(spark, d):
    uids = B.corpus(spark, d).join(B.read(spark, d, "labels").where("toxic = 0"), "doc_id", "left_semi").select("uid")
    return B.features(spark, d).select("uid", "f_words").join(uids, "uid", "left_semi")


@query("j04_missing_features", sql("SELECT uid FROM corpus WHERE uid NOT IN (SELECT uid FROM have)", "corpus", "features", have=HAVE))
def j04(spark, d):
    require_coverage(covered(spark, d), B.features(spark, d), "uid")  # the strict form: raises if any is missing
    return B.corpus(spark, d).select("uid").join(covered(spark, d), "uid", "left_anti").select("uid")


@query("j05_zero_default", sql("SELECT c.uid, coalesce(f_chars,0.0::DOUBLE) AS f_chars, coalesce(f_words,0.0::DOUBLE) AS f_words FROM corpus c LEFT JOIN have USING (uid)", "corpus", "features", have=HAVE))
def j05(spark, d):
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return B.corpus(spark, d).select("uid").join(covered(spark, d), "uid", "left").select("uid", zero("f_chars"), zero("f_words"))


@query("j06_backfill", sql("SELECT uid, f_chars, FALSE AS filled FROM have UNION ALL SELECT uid, f_chars, TRUE FROM features WHERE uid NOT IN (SELECT uid FROM have)", "features", have=HAVE))
def j06(spark, d):
    have = covered(spark, d).select("uid", "f_chars")
    missing = B.corpus(spark, d).select("uid").join(have, "uid", "left_anti")
    fresh = B.features(spark, d).join(missing, "uid", "left_semi").select("uid", "f_chars")
    return have.withColumn("filled", F.lit(False)).unionByName(fresh.withColumn("filled", F.lit(True)))


@query("p21_l2_normalize", "SELECT vec_id, round(embedding[1]/n,6) AS e0, round(embedding[64]/n,6) AS e63 FROM (SELECT *, sqrt(list_sum([CAST(x AS DOUBLE)*CAST(x AS DOUBLE) FOR x IN embedding])) AS n FROM embeddings)")
def p21(spark, d):
    e = B.read(spark, d, "embeddings").select("vec_id", C.l2_normalized(F.col("embedding")).alias("e"))
    return e.select("vec_id", C.r6(F.get("e", F.lit(0))).alias("e0"), C.r6(F.get("e", F.lit(63))).alias("e63"))


@query("p22_late_fusion", sql("SELECT e.vec_id, 69 AS width, round(CAST(embedding[1] AS DOUBLE),6) AS v0, round((f_words-mu_f_words)/sd_f_words,6) AS v68 FROM embeddings e JOIN features f ON f.doc_id=e.vec_id, s", "features", s=scaler_sql("1e-6")))
def p22(spark, d):
    f = B.features(spark, d)
    z = X.standardized(f.drop("label", "uid"), X.fit_scaler(f, FEATURES), FEATURES)
    j = B.read(spark, d, "embeddings").join(z, F.col("vec_id") == F.col("doc_id"))
    v = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(*FEATURES))
    w = G.measured(j.select("vec_id", v.alias("v")), "v", 64 + len(FEATURES))
    return w.select("vec_id", F.size("v").alias("width"), C.r6(F.get("v", F.lit(0))).alias("v0"), C.r6(F.get("v", F.lit(68))).alias("v68"))
