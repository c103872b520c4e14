"""Logical tables over the test tables: each as a DataFrame and as the same DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import portable_hash


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus metadata: sources below 5 are real, the others generators."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    docs = read(spark, d, "documents")
    return docs.select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uid"), "doc_id", F.col("lang").alias("dataset"), "source",
        F.when(n < 5, 0).otherwise(1).alias("label"), F.when(n < 5, F.lit("real:unknown")).otherwise(F.col("source")).alias("generator"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Two models' scores by sample, heavily tied."""
    e = read(spark, d, "events")
    half = lambda x: F.floor(x * 100 + 0.5) / 100.0
    y = (F.col("value") >= 60).cast("int")
    a = F.col("event_id") * 7919 % 1000 / 1000.0 * 0.6 + F.least("value", F.lit(150.0)) / 150.0 * 0.4
    b = F.col("event_id") * 104729 % 1000 / 1000.0 * 0.8 + F.least("value", F.lit(120.0)) / 120.0 * 0.4
    return e.select(
        F.col("event_id").alias("id"), y.alias("y"), F.when(y == 1, F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string"))).otherwise("real:unknown").alias("generator"),
        F.when(F.col("event_id") % 5 == 0, "val").when(F.col("event_id") % 5 == 1, "logo").otherwise("train").alias("split"),
        half(a).alias("p_a"), F.least(F.lit(1.0), half(b)).alias("p_b"),
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """Training history: five runs of thirty epochs."""
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("tag"), F.dayofmonth("ts").alias("epoch")).agg((F.sum(F.floor(F.col("value") * 100 + 0.5)) / 100.0 / F.count("*")).alias("v"))
    four = lambda x: F.floor(x * 10000 + 0.5) / 10000.0
    return e.select("tag", "epoch", four(1.5 - F.col("v") / 100.0).alias("loss"), four(F.col("v") / 250.0 + 0.5).alias("val_auc"), four(0.9 - F.col("v") / 260.0).alias("logo_auc"))


def runs(spark: SparkSession) -> DataFrame:
    """Configuration of the runs. Fixed values."""
    rows = [("click", True, "linear", 0, 1e-3, 769, 27820000), ("view", True, "mlp", 0, 1e-3, 295682, 28114913), ("purchase", True, "fusion", 33, 1e-3, 308354, 28127585), ("error", False, "mlp", 0, 1e-4, 14568290, 28114913), ("signup", False, "fusion", 33, 1e-4, 14580962, 28127585)]
    return spark.createDataFrame(rows, "tag string, frozen boolean, head string, feature_dim int, lr double, trainable_params long, total_params long")


FEATURES = ["f_chars", "f_digits", "f_lines", "f_upper", "f_words"]


def features(spark: SparkSession, d: str) -> DataFrame:
    """Text features by uid."""
    docs = read(spark, d, "documents")
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    size = F.length("text")
    return docs.select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uid"), "doc_id", F.when(n < 5, 0).otherwise(1).alias("label"), size.cast("double").alias("f_chars"),
        (size - F.length(F.regexp_replace("text", "[0-9]", ""))).cast("double").alias("f_digits"), (size - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("double").alias("f_lines"),
        (size - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("double").alias("f_upper"), (size - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("double").alias("f_words"),
    )


def paths(spark: SparkSession, d: str) -> DataFrame:
    """File paths by page."""
    k = F.col("page_id")
    folder = F.element_at(F.array(F.lit("AI-Generated"), F.lit("real art"), F.lit("misc")), (k % 3 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".gif", ".txt"))), (k % 4 + 1).cast("int"))
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1)
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("/corpus/"), folder, F.lit("/"), lang, F.lit("/"), (k % 10).cast("string"), ext).alias("path"), F.length("html").cast("long").alias("bytes"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 grey tiles as pixel rows (img, y, x, v)."""
    p = read(spark, d, "embeddings").select(F.col("vec_id").alias("img"), "label", F.posexplode("embedding").alias("k", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 512 + 128.5))).cast("int")
    return p.select("img", "label", F.expr("k div 8").cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), v.alias("v"))


def rgb_tiles(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 colour tiles as pixel rows (img, y, x, r, g, b): three grey tiles in a row make one."""
    of = lambda k, n: F.max(F.when(F.col("img") % 3 == k, F.col("v"))).alias(n)
    t = tiles(spark, d).groupBy(F.expr("img div 3").alias("i"), "y", "x").agg(of(0, "r"), of(1, "g"), of(2, "b"), F.count("*").alias("n"))
    return t.where("n = 3").select(F.col("i").alias("img"), "y", "x", "r", "g", "b")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uid"), (F.col("p_size") * 16).cast("long").alias("w"), (F.col("p_partkey") * 37 % 512 + 64).cast("long").alias("h"))


HASH = "CAST('0x'||substr(md5({key}||':{seed}'),1,15) AS BIGINT)"


def hash_sql(key: str, seed: int | str) -> str:
    return HASH.format(key=key, seed=seed)


_N = "CAST(regexp_extract(source,'[0-9]+') AS INT)"
CTE = {
    "corpus": f"""SELECT 'documents/'||doc_id AS uid, doc_id, lang AS dataset, source, CASE WHEN {_N}<5 THEN 0 ELSE 1 END AS label,
        CASE WHEN {_N}<5 THEN 'real:unknown' ELSE source END AS generator FROM documents""",
    "scores": """SELECT event_id AS id, CASE WHEN value>=60 THEN 1 ELSE 0 END AS y, CASE WHEN value>=60 THEN 'g'||(user_id%8) ELSE 'real:unknown' END AS generator,
        CASE WHEN event_id%5=0 THEN 'val' WHEN event_id%5=1 THEN 'logo' ELSE 'train' END AS split,
        floor((event_id*7919%1000/1000.0::DOUBLE*0.6::DOUBLE+least(value,150.0::DOUBLE)/150.0::DOUBLE*0.4::DOUBLE)*100+0.5::DOUBLE)/100.0::DOUBLE AS p_a,
        least(1.0::DOUBLE,floor((event_id*104729%1000/1000.0::DOUBLE*0.8::DOUBLE+least(value,120.0::DOUBLE)/120.0::DOUBLE*0.4::DOUBLE)*100+0.5::DOUBLE)/100.0::DOUBLE) AS p_b FROM events""",
    "history": """SELECT tag, epoch, floor((1.5::DOUBLE-v/100.0::DOUBLE)*10000+0.5::DOUBLE)/10000.0::DOUBLE AS loss, floor((v/250.0::DOUBLE+0.5::DOUBLE)*10000+0.5::DOUBLE)/10000.0::DOUBLE AS val_auc,
        floor((0.9::DOUBLE-v/260.0::DOUBLE)*10000+0.5::DOUBLE)/10000.0::DOUBLE AS logo_auc
        FROM (SELECT event_type AS tag, CAST(day(ts) AS INT) AS epoch, CAST(sum(CAST(floor(value*100+0.5::DOUBLE) AS BIGINT)) AS DOUBLE)/100.0::DOUBLE/count(*) AS v FROM events GROUP BY 1,2)""",
    "runs": """SELECT * FROM (VALUES ('click',TRUE,'linear',0,1e-3,769,27820000),('view',TRUE,'mlp',0,1e-3,295682,28114913),('purchase',TRUE,'fusion',33,1e-3,308354,28127585),
        ('error',FALSE,'mlp',0,1e-4,14568290,28114913),('signup',FALSE,'fusion',33,1e-4,14580962,28127585)) t(tag,frozen,head,feature_dim,lr,trainable_params,total_params)""",
    "features": f"""SELECT 'documents/'||doc_id AS uid, doc_id, CASE WHEN {_N}<5 THEN 0 ELSE 1 END AS label, CAST(length(text) AS DOUBLE) AS f_chars,
        CAST(length(text)-length(regexp_replace(text,'[0-9]','','g')) AS DOUBLE) AS f_digits, CAST(length(text)-length(replace(text,chr(10),''))+1 AS DOUBLE) AS f_lines,
        CAST(length(text)-length(regexp_replace(text,'[A-Z]','','g')) AS DOUBLE) AS f_upper, CAST(length(text)-length(replace(text,' ',''))+1 AS DOUBLE) AS f_words FROM documents""",
    "paths": """SELECT page_id, '/corpus/'||CASE page_id%3 WHEN 0 THEN 'AI-Generated' WHEN 1 THEN 'real art' ELSE 'misc' END||'/'||regexp_extract(url,'^https?://[^/]+/([a-z]{2})/',1)||'/'||(page_id%10)||
        CASE page_id%4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.gif' ELSE '.txt' END AS path, CAST(length(html) AS BIGINT) AS bytes FROM pages""",
    "tiles": """SELECT vec_id AS img, label, CAST((k-1)//8 AS INT) AS y, CAST((k-1)%8 AS INT) AS x, CAST(greatest(0,least(255,floor(CAST(embedding[k] AS DOUBLE)*512+128.5::DOUBLE))) AS INT) AS v
        FROM embeddings, range(1,65) r(k)""",
    "rgb": "SELECT img//3 AS img, y, x, max(v) FILTER (img%3=0) AS r, max(v) FILTER (img%3=1) AS g, max(v) FILTER (img%3=2) AS b FROM raw GROUP BY ALL HAVING count(*)=3",
    "grey": "SELECT img, y, x, CAST((299*r+587*g+114*b+500)//1000 AS INT) AS v FROM rgb",
    "sizes": "SELECT 'part/'||p_partkey AS uid, CAST(p_size*16 AS BIGINT) AS w, CAST(p_partkey*37%512+64 AS BIGINT) AS h FROM part",
}


def sql(body: str, *names: str, **more: str) -> str:
    """`body` under the named tables, and more of its own."""
    tables = [f"{n} AS ({CTE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(tables)} {body}" if tables else body


__all__ = ["CTE", "FEATURES", "corpus", "features", "hash_sql", "history", "paths", "portable_hash", "read", "rgb_tiles", "runs", "scores", "sizes", "sql", "tiles"]
