"""Queries over corpus metadata: signatures, dedup, splits and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import dedup as D
from millrace.operators import gates as G
from millrace.operators import sketches as K
from millrace.operators import splits as P
from millrace.plans import bindings as B
from millrace.plans.bindings import hash_sql, sql
from millrace.sources import files
from millrace.sources.scratch import cut, temporary

QUERIES, ORACLES = {}, {}
FAMILIES = {"gan": ["src5", "src6"], "sd1x": ["src10"], "modern_open": ["src15", "src16"], "commercial": []}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


SHINGLES = """SELECT DISTINCT doc_id, unnest(CASE WHEN len(w)>=3 THEN [w[i]||' '||w[i+1]||' '||w[i+2] FOR i IN range(1,len(w)-1)] ELSE [array_to_string(w,' ')] END) AS s
 FROM (SELECT doc_id, list_filter(string_split_regex(lower(text),'[ \\t\\n\\r]+'), lambda x: x<>'') AS w FROM documents) WHERE len(w)>0"""
HASHED = "SELECT doc_id, CAST('0x'||substr(md5(s),1,16) AS UBIGINT) AS h FROM shingles"
SIGNED = "SELECT doc_id, CAST(" + "+".join(f"CASE WHEN sum(CAST((h>>{k})&1 AS INT))*2>count(*) THEN {1 << k if k < 63 else -(1 << 63)}::HUGEINT ELSE 0 END" for k in range(64)) + " AS BIGINT) AS sig FROM hashed GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM shingles)"
SIGS = dict(shingles=SHINGLES, hashed=HASHED, sigs=SIGNED)


NEAR = "bit_count(xor(a.sig,b.sig))<=4"


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return cut(D.text_signature(B.read(spark, d, "documents")))


def signed_corpus(spark: SparkSession, d: str) -> DataFrame:
    return B.corpus(spark, d).join(signatures(spark, d), "doc_id")


@query("c06_text_signature", sql("SELECT doc_id, sig FROM sigs", **SIGS))
def c06(spark, d):
    return signatures(spark, d)


@query("p23_popcount_bands", sql("SELECT doc_id, CAST(bit_count(xor(sig, -1)) AS INT) AS zeros, sig&65535 AS b0, (sig>>16)&65535 AS b1, (sig>>32)&65535 AS b2, (sig>>48)&65535 AS b3 FROM sigs", **SIGS))
def p23(spark, d):
    s = signatures(spark, d).withColumn("b", C.bands(F.col("sig")))
    return s.select("doc_id", C.hamming(F.col("sig"), F.lit(-1).cast("long")).cast("int").alias("zeros"), *[F.get("b", F.lit(k))["value"].alias(f"b{k}") for k in range(4)])


PAIRS = f"SELECT least(x.id,y.id) AS id_a, greatest(x.id,y.id) AS id_b, CAST(bit_count(xor(a.sig,b.sig)) AS INT) AS distance FROM f a JOIN f b ON a.sig<b.sig AND {NEAR} JOIN f x ON x.sig=a.sig JOIN f y ON y.sig=b.sig"
FIRST = "SELECT sig, min(doc_id) AS id FROM sigs GROUP BY sig"


@query("j07_similar_pairs", sql(PAIRS, **SIGS, f=FIRST))
def j07(spark, d):
    return D.similar_pairs(signatures(spark, d))


@query("w05_every_second_copy", sql("SELECT doc_id, row_number() OVER (PARTITION BY sig ORDER BY doc_id)%2=1 AS kept FROM sigs", **SIGS))
def w05(spark, d):
    return D.drop_every_second(signatures(spark, d)).select("doc_id", "kept")


def kept_sql(n: str) -> str:
    return f"SELECT b.doc_id, b.sig, NOT EXISTS (SELECT 1 FROM sigs a WHERE a.doc_id<b.doc_id AND {n}) AS kept FROM sigs b"


@query("c02_keep_first", sql("SELECT doc_id, kept FROM k", **SIGS, k=kept_sql(NEAR)))
def c02(spark, d):
    return D.keep_first(signatures(spark, d)).select("doc_id", "kept")


@query("c03_full_recall", sql("SELECT doc_id, kept FROM k", **SIGS, k=kept_sql(NEAR)))
def c03(spark, d):
    """With the same keys as c02, which find every pair: five bands of 13 bits do so too, but a band's 8,192 values each meet in pairs."""
    return D.keep_first(signatures(spark, d)).select("doc_id", "kept")


@query("c01_greedy_passes")
def c01(spark, d):
    return D.greedy_passes(signatures(spark, d)).select("doc_id", "kept")


DATASETS = f"SELECT least(x.dataset,y.dataset) AS dataset_a, greatest(x.dataset,y.dataset) AS dataset_b, count(*) AS pairs FROM sigs a JOIN sigs b ON a.doc_id<b.doc_id AND {NEAR} JOIN corpus x ON x.doc_id=a.doc_id JOIN corpus y ON y.doc_id=b.doc_id GROUP BY ALL"


@query("a03_pairs_by_dataset", sql(DATASETS, "corpus", **SIGS))
def a03(spark, d):
    return D.pair_counts(signed_corpus(spark, d))


@query("t4_top_pairs", sql(f"SELECT * FROM ({DATASETS}) ORDER BY pairs DESC, dataset_a, dataset_b LIMIT 12", "corpus", **SIGS))
def t4(spark, d):
    return D.pair_counts(signed_corpus(spark, d)).orderBy(F.desc("pairs"), "dataset_a", "dataset_b").limit(12)


@query("p02_generator_names", sql("SELECT uid, CASE WHEN label=0 THEN 'real:'||lower(coalesce(nullif(trim(CASE WHEN doc_id%3=0 THEN '  ' ELSE ' '||upper(dataset) END),''),'unknown')) ELSE coalesce(nullif(trim(CASE WHEN doc_id%5=0 THEN '' ELSE source||' ' END),''),'unknown') END AS generator FROM corpus", "corpus"))
def p02(spark, d):
    model = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("source", F.lit(" ")))
    source = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("dataset")))
    return B.corpus(spark, d).select("uid", C.norm_generator(F.col("label"), model, source).alias("generator"))


@query("p10_pattern_match", sql("SELECT uid, contains(lower(generator),'src1') AS one, contains(lower(generator),'src5') OR contains(lower(generator),'src6') AS any_of FROM corpus", "corpus"))
def p10(spark, d):
    g = F.lower("generator")
    return B.corpus(spark, d).select("uid", F.contains(g, F.lit("src1")).alias("one"), F.exists(F.array(F.lit("src5"), F.lit("src6")), lambda p: F.contains(g, p)).alias("any_of"))


@query("a01_split_counts", sql("SELECT dataset, count(*) FILTER (label=0) AS n_real, count(*) FILTER (label=1) AS n_fake, count(*) AS n FROM corpus GROUP BY dataset", "corpus"))
def a01(spark, d):
    c = B.corpus(spark, d)
    return c.groupBy("dataset").agg(F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"), F.count("*").alias("n"))


@query("a02_distinct_generators", sql("SELECT dataset, count(DISTINCT generator) AS n, count(DISTINCT CASE WHEN label=1 THEN generator END) AS n_fake FROM corpus GROUP BY dataset", "corpus"))
def a02(spark, d):
    return B.corpus(spark, d).groupBy("dataset").agg(F.count_distinct("generator").alias("n"), F.count_distinct(F.when(F.col("label") == 1, F.col("generator"))).alias("n_fake"))


@query("a20_class_weights", sql("SELECT label, count(*) AS n, round((1.0::DOUBLE/count(*))/sum(1.0::DOUBLE/count(*)) OVER (),6) AS inverse, round(sum(count(*)) OVER ()/(2.0::DOUBLE*count(*)),6) AS balanced FROM corpus GROUP BY label", "corpus"))
def a20(spark, d):
    g = B.corpus(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return g.select("label", "n", C.r6((1 / F.col("n")) / F.sum(1 / F.col("n")).over(whole)).alias("inverse"), C.r6(F.sum("n").over(whole) / (2.0 * F.col("n"))).alias("balanced"))


@query("a25_ingest_summary", sql("SELECT dataset, count(*) AS n_rows, count(*) FILTER (doc_id%17=0) AS failures FROM corpus GROUP BY dataset UNION ALL SELECT 'total', count(*), count(*) FILTER (doc_id%17=0) FROM corpus", "corpus"))
def a25(spark, d):
    c = B.corpus(spark, d).withColumn("failed", F.col("doc_id") % 17 == 0)
    agg = [F.count("*").alias("n_rows"), F.count_if("failed").alias("failures")]
    return c.groupBy("dataset").agg(*agg).unionByName(c.agg(*agg).withColumn("dataset", F.lit("total")))


def rank_sql(src: str, group: str, key: str, seed: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {hash_sql(key, seed)}, {key})-1"


@query("w06_group_cap", sql(f"SELECT uid, rank>=(SELECT greatest(1,count(*)//50) FROM corpus WHERE label=1) AS over FROM (SELECT *, {rank_sql('corpus', 'generator', 'uid', 'cap')} AS rank FROM corpus WHERE label=1)", "corpus"))
def w06(spark, d):
    return P.capped(B.corpus(spark, d).where("label = 1"), "generator", "uid", 50, "cap").select("uid", "over")


def alloc_sql(src: str) -> str:
    return f"SELECT generator, n, coalesce(sum(n) OVER (ORDER BY {hash_sql('generator', 'groups')}, generator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)*100<sum(n) OVER ()*15 AS chosen FROM (SELECT generator, count(*) AS n FROM {src} GROUP BY generator)"


@query("w07_group_allocation", sql("SELECT * FROM a", "corpus", f="SELECT * FROM corpus WHERE label=1", a=alloc_sql("f")))
def w07(spark, d):
    return P.allocated(B.corpus(spark, d).where("label = 1"), "generator", 15, "groups")


@query("w08_class_balance", sql(f"SELECT uid, rank>=(SELECT least(count(*) FILTER (label=0),count(*) FILTER (label=1)) FROM corpus) AS over FROM (SELECT *, {rank_sql('corpus', 'label', 'uid', 'balance')} AS rank FROM corpus)", "corpus"))
def w08(spark, d):
    return P.balanced(B.corpus(spark, d), "label", "uid", "balance").select("uid", "over")


@query("w09_seeded_sample", sql(f"SELECT uid, label FROM (SELECT *, {rank_sql('corpus', 'label', 'uid', '42')} AS r FROM corpus) WHERE r<40", "corpus"))
def w09(spark, d):
    return P.hash_rank(B.corpus(spark, d), ["label"], "uid", 42).where("rank < 40").select("uid", "label")


@query("w10_position_split", sql(f"SELECT uid, CASE WHEN rank<n-n*15//100-n*15//100 THEN 'train' WHEN rank<n-n*15//100 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {rank_sql('corpus', '1', 'uid', '7')} AS rank, count(*) OVER () AS n FROM corpus)", "corpus"))
def w10(spark, d):
    r = P.with_total(P.hash_rank(B.corpus(spark, d), [], "uid", 7), F.count("*"), "n")
    part = F.expr("n * 15 div 100")
    return r.select("uid", F.when(F.col("rank") < F.col("n") - 2 * part, "train").when(F.col("rank") < F.col("n") - part, "val").otherwise("test").alias("split"))


@query("w10_stratified_split", sql(f"SELECT uid, label, CASE WHEN rank<n*80//100 THEN 'train' ELSE 'test' END AS split FROM (SELECT *, {rank_sql('corpus', 'label', 'uid', '7')} AS rank, count(*) OVER (PARTITION BY label) AS n FROM corpus)", "corpus"))
def w10s(spark, d):
    c = B.corpus(spark, d)
    sizes = c.groupBy("label").agg(F.count("*").alias("n"))
    r = P.hash_rank(c, ["label"], "uid", 7).join(F.broadcast(sizes), "label")
    return r.select("uid", "label", F.when(F.col("rank") < F.expr("n * 80 div 100"), "train").otherwise("test").alias("split"))


HELD = f"""SELECT 'gan' AS family, generator, n FROM (SELECT generator, count(*) AS n FROM k WHERE label=1 AND (contains(lower(generator),'src5') OR contains(lower(generator),'src6')) GROUP BY ALL ORDER BY n DESC, generator LIMIT 3)
 UNION ALL SELECT 'sd1x', generator, n FROM (SELECT generator, count(*) AS n FROM k WHERE label=1 AND contains(lower(generator),'src10') GROUP BY ALL ORDER BY n DESC, generator LIMIT 3)
 UNION ALL SELECT 'modern_open', generator, n FROM (SELECT generator, count(*) AS n FROM k WHERE label=1 AND (contains(lower(generator),'src15') OR contains(lower(generator),'src16')) GROUP BY ALL ORDER BY n DESC, generator LIMIT 3)"""


@query("c04_held_out_families", sql("SELECT * FROM h", "corpus", k="SELECT * FROM corpus", h=HELD))
def c04(spark, d):
    g = B.corpus(spark, d).groupBy("generator").agg(F.count("*").alias("n")).withColumn("tagged", F.lit(False))
    return P.held_out(g, FAMILIES)


@query("u5_missing_families", sql("SELECT family FROM (VALUES ('gan'),('sd1x'),('modern_open'),('commercial')) t(family) EXCEPT SELECT family FROM h", "corpus", k="SELECT * FROM corpus", h=HELD))
def u5(spark, d):
    wanted = spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    return wanted.subtract(c04(spark, d).select("family"))


ALL = dict(
    **SIGS, kk=kept_sql(NEAR), r="SELECT c.*, kk.sig, kk.kept FROM corpus c JOIN kk USING (doc_id)", k="SELECT * FROM r WHERE kept", h=HELD,
    fakes="SELECT * FROM k WHERE label=1 AND generator NOT IN (SELECT generator FROM h)", capped=f"SELECT *, {rank_sql('fakes', 'generator', 'uid', 'cap')}>=(SELECT greatest(1,count(*)//50) FROM fakes) AS over FROM fakes",
    pool="SELECT * FROM capped WHERE NOT over", alloc=alloc_sql("pool"),
    reals=f"SELECT *, {rank_sql('k', '1', 'uid', 'reals')} AS rank, count(*) OVER ()*15//100 AS cut FROM k WHERE label=0",
    parts="""SELECT uid, label, generator, CASE WHEN over THEN 'capped_out' WHEN chosen THEN 'val' ELSE 'train' END AS split FROM capped LEFT JOIN alloc USING (generator)
     UNION ALL SELECT uid, label, generator, CASE WHEN rank<cut THEN 'logo' WHEN rank<2*cut THEN 'val' ELSE 'train' END FROM reals UNION ALL SELECT uid, label, generator, 'logo' FROM k WHERE generator IN (SELECT generator FROM h)""",
    ranked=f"SELECT *, {rank_sql('parts', 'label', 'uid', 'balance')} AS rank FROM parts WHERE split='train'",
    done="""SELECT uid, label, generator, CASE WHEN rank>=(SELECT least(count(*) FILTER (label=0),count(*) FILTER (label=1)) FROM ranked) THEN 'balanced_out' ELSE 'train' END AS split FROM ranked
     UNION ALL SELECT * FROM parts WHERE split<>'train' UNION ALL SELECT uid, label, generator, 'dropped_dup' FROM r WHERE NOT kept""",
)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    kept = D.keep_first(signatures(spark, d))
    return P.split_corpus(B.corpus(spark, d).join(kept, "doc_id"), FAMILIES)


@query("c05_full_split", sql("SELECT uid, label, generator, split FROM done", "corpus", **ALL))
def c05(spark, d):
    return manifest(spark, d)


@query("q8_split_summary", sql("SELECT split, count(*) AS n, count(*) FILTER (label=1) AS n_fake, count(DISTINCT generator) AS generators FROM done GROUP BY split", "corpus", **ALL))
def q8(spark, d):
    return manifest(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_fake"), F.count_distinct("generator").alias("generators"))


LEAK = """WITH_ SELECT 'train_val_generators' AS rule, count(*) AS violations FROM (SELECT generator FROM m WHERE split='train' AND label=1 INTERSECT SELECT generator FROM m WHERE split='val' AND label=1)
 UNION ALL SELECT 'train_logo_generators', count(*) FROM (SELECT generator FROM m WHERE split='train' AND label=1 INTERSECT SELECT generator FROM m WHERE split='logo' AND label=1)
 UNION ALL SELECT 'val_logo_generators', count(*) FROM (SELECT generator FROM m WHERE split='val' AND label=1 INTERSECT SELECT generator FROM m WHERE split='logo' AND label=1)
 UNION ALL SELECT 'train_logo_signatures', count(*) FROM (SELECT sig FROM m WHERE split='train' INTERSECT SELECT sig FROM m WHERE split='logo')
 UNION ALL SELECT 'val_without_reals', CAST(count(*) FILTER (split='val' AND label=0)=0 AS BIGINT) FROM m UNION ALL SELECT 'logo_without_reals', CAST(count(*) FILTER (split='logo' AND label=0)=0 AS BIGINT) FROM m""".removeprefix("WITH_ ")


@query("u3_leakage", sql(LEAK, "corpus", **ALL, m="SELECT done.*, r.sig FROM done JOIN r USING (uid)"))
def u3(spark, d):
    rows = manifest(spark, d).join(signed_corpus(spark, d).select("uid", "sig"), "uid")
    return P.leakage(rows)


@query("u4_selected_uids", sql(f"SELECT uid, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {hash_sql('uid', 11)}, uid)-1 AS rank FROM done WHERE split IN ('train','val','logo')) WHERE rank<CASE split WHEN 'train' THEN 60 ELSE 30 END", "corpus", **ALL))
def u4(spark, d):
    m = manifest(spark, d).where(F.col("split").isin("train", "val", "logo"))
    return P.hash_rank(m, ["split"], "uid", 11).where(F.col("rank") < F.when(F.col("split") == "train", 60).otherwise(30)).select("uid", "split")


@query("u1_union_of_classes", sql("SELECT uid, 1 AS label FROM corpus WHERE label=1 UNION ALL SELECT uid, 0 FROM corpus WHERE label=0", "corpus"))
def u1(spark, d):
    c = B.corpus(spark, d)
    return c.where("label = 1").select("uid", F.lit(1).alias("label")).unionByName(c.where("label = 0").select("uid", F.lit(0).alias("label")))


@query("j12_eval_sources_in_training", sql("SELECT dataset, count(*) AS n FROM done JOIN corpus USING (uid) WHERE split='train' AND dataset IN ('fr','es') GROUP BY dataset", "corpus", **ALL))
def j12(spark, d):
    """Training rows of two sources, as the check of `j12_gated_training` would count them."""
    tagged = spark.createDataFrame([("fr",), ("es",)], "dataset string")
    train = manifest(spark, d).where("split = 'train'").join(B.corpus(spark, d).select("uid", "dataset"), "uid")
    return train.join(F.broadcast(tagged), "dataset", "left_semi").groupBy("dataset").agg(F.count("*").alias("n"))


@query("j12_gated_training", sql("SELECT uid, generator FROM done WHERE split='train'", "corpus", **ALL))
def j12_gated(spark, d):
    """The training rows, which the job hands out only if no generator kept for evaluation is among them."""
    rows = manifest(spark, d)
    train = rows.where("split = 'train'").select("uid", "generator")
    return G.excluded(train, rows.where("split = 'logo' and label = 1").select("generator").distinct(), "generator", "evaluation source in training")


@query("u3_gated_split", sql("SELECT uid, label, generator, split FROM done", "corpus", **ALL))
def u3_gated(spark, d):
    """The split, which the job hands out only if no generator is on two sides of it."""
    rows = manifest(spark, d)
    broken = P.leakage(rows.withColumn("sig", F.lit(None).cast("long"))).where("rule like '%_generators' and violations > 0")
    return G.gate(rows, broken, "leaking split")


@query("a02_distinct_sketched", sql(f"SELECT dataset, CAST(count(DISTINCT generator) AS BIGINT) AS generators, count(DISTINCT uid) AS uids, TRUE AS within FROM corpus GROUP BY dataset UNION ALL SELECT 'all', count(DISTINCT generator), count(DISTINCT uid), TRUE FROM corpus", "corpus"))
def a02_sketched(spark, d):
    """Distinct values from sketches kept by shard (source and language), saved, read again and merged by language and over all; few values count exactly, many within three standard errors."""
    c, at = B.corpus(spark, d), temporary(spark, "sketches")
    files.write_parquet(K.shard_sketches(c, ["dataset", "source"], {"g": F.col("generator"), "u": F.col("uid")}), at)
    kept = spark.read.parquet(at)
    by = K.merged(kept, ["dataset"], ["g", "u"])
    whole = K.merged(by.withColumn("dataset", F.lit("all")), ["dataset"], ["g", "u"])
    exact = lambda rows: rows.groupBy("dataset").agg(F.count_distinct("uid").alias("uids"))
    counted = exact(c).unionByName(exact(c.withColumn("dataset", F.lit("all"))))
    e = K.estimates(by.unionByName(whole), ["g", "u"]).join(counted, "dataset")
    return e.select("dataset", F.col("g").alias("generators"), "uids", (F.abs(F.col("u") - F.col("uids")) <= K.error_bound() * F.col("uids")).alias("within"))


@query("w12_top_groups", sql("SELECT dataset, generator, n FROM (SELECT dataset, generator, count(*) AS n FROM corpus WHERE label=1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, generator)<=3", "corpus"))
def w12_top(spark, d):
    g = B.corpus(spark, d).where("label = 1").groupBy("dataset", "generator").agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "generator"))).where("k <= 3").drop("k")
