"""The corpus operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, licenses, media, packing, quality, secrets, sharding, simhash, spelling, substring, suffix, topk, trie
from millrace.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("t1", "t2")


def op9_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(documents(spark, sf_dir)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_weak_label_quality,
        op2_label_propagation_shards,
        op3_recompression_dedup,
        op4_license_classifier,
        op5_secret_scan,
        op6_simhash_golay,
        op7_hierarchical_packing,
        op8_minhash_containment,
        op9_columnwise_suffix_dedup,
        op10_jpeg_media,
        op11_spelling_variants,
        op12_prefix_trie,
        op13_exact_topk,
    )
}
_WORDS = r"list_filter(string_split_regex(lower(text),'[^\p{L}\p{N}]+'), lambda x: x<>'')"
_SHINGLES = "CASE WHEN len(w)>=5 THEN [array_to_string(w[i:i+4],' ') FOR i IN range(1,len(w)-3)] WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END"
_GRAMS = "list_concat(" * 4 + ", ".join([f"[array_to_string(w[i:i+{m - 1}],' ') FOR i IN range(1,greatest(1,len(w)+{2 - m}))]" + (")" if m > 1 else "") for m in range(1, 6)])
#: CRC-32 of a list of bytes, by a table built from the polynomial.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"
_ASCII = "list_transform(string_split({s}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
_LATIN = "flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))"

ORACLES: dict[str, str] = {
    "op3_recompression_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text,''),'[\x20\x09-\x0D]+'), lambda x: x<>'') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s+49],' ')) AS h FROM (SELECT doc_id, w, unnest(range(1,len(w)-48)) AS s FROM d WHERE len(w)>=50)),
gone AS (SELECT win.doc_id, s FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE first<win.doc_id),
word AS (SELECT doc_id, unnest(range(1,len(w)+1)) AS k, unnest(w) AS word FROM d),
cut AS (SELECT word.*, max(g.s) OVER (PARTITION BY word.doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS hit FROM word LEFT JOIN gone g ON g.doc_id=word.doc_id AND g.s=word.k),
kept AS (SELECT doc_id, count(*) FILTER (hit) AS n_removed, string_agg(word,' ' ORDER BY k) FILTER (NOT hit) AS t FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed,0) AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_containment": f"""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS t, unnest({_GRAMS}) AS s FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)),
i AS (SELECT DISTINCT item_id, x, unnest({_SHINGLES}) AS s FROM (SELECT item_id, md5(text) AS x, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL)),
n AS (SELECT x, count(DISTINCT s) AS n_item FROM i GROUP BY x)
SELECT doc_id, item_id, n_shared, n_item, round(CAST(n_shared AS DOUBLE)/n_item,6) AS containment
FROM (SELECT doc_id, t, item_id, x, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL) JOIN n USING (x) WHERE n_shared>=0.8::DOUBLE*n_item""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE tbl AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {_CRC.format(bytes=_LATIN.format(s="coalesce(CAST(doc_id AS VARCHAR),'') || ':' || run"))} AS h FROM runs, tbl),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h%97=0 THEN substr(run,1,h%length(run)) || substr(run,h%length(run)+2) ELSE run END AS word, k FROM hashed) WHERE length(word)>=5 GROUP BY word HAVING sum(k)>=3),
del AS (SELECT word, n, i, substr(word,1,i-1) || substr(word,i+1) AS d FROM (SELECT word, n, unnest(range(1,length(word)+1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM del a JOIN del b USING (i,d) WHERE a.word<>b.word
 UNION SELECT del.word, del.n, w.word, w.n FROM del JOIN words w ON w.word=del.d UNION SELECT w.word, w.n, del.word, del.n FROM del JOIN words w ON w.word=del.d),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n, other_n>=2*n AS holds, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
judged AS (SELECT word, n_near, CASE WHEN holds THEN other END AS form, CASE WHEN holds THEN other_n END AS form_n FROM best WHERE r=1),
up AS (SELECT word, word AS root, 0 AS step FROM words UNION ALL SELECT up.word, j.form, step+1 FROM up JOIN judged j ON j.word=up.root WHERE j.form IS NOT NULL)
SELECT word, n, coalesce(n_near,0) AS n_near, form, form_n, root FROM words LEFT JOIN judged USING (word) JOIN (SELECT word, arg_max(root,step) AS root FROM up GROUP BY word) USING (word)""",
    "op12_prefix_trie": rf"""
WITH tbl AS ({_CRC_TABLE}),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id-conv_id%20 AS base, {_CRC.format(bytes=_ASCII.format(s="CAST(conv_id AS VARCHAR)"))}%4 AS h FROM (SELECT DISTINCT conv_id FROM t), tbl),
part AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id=c.base WHERE p<=h UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p>h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth, md5(length(role) || ':' || role || text) AS m, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM part),
chain AS (SELECT conv_id, depth, words, md5(string_agg(m,'') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r),
member AS (SELECT conv_id, 0 AS depth, '' AS node, NULL AS up, 0 AS words FROM c UNION ALL SELECT conv_id, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth),''), words FROM chain),
node AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM member GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT m.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((v.n_convs-1)*v.words) AS saved FROM node v LEFT JOIN kids USING (node) JOIN member m ON m.conv_id=v.conv_id AND m.depth<=v.depth GROUP BY m.node),
stop AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node,depth) AS node FROM member GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children,0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids,'')) AS ends_sha256
FROM node n LEFT JOIN node p ON p.node=n.up LEFT JOIN kids k ON k.node=n.node JOIN below b ON b.node=n.node LEFT JOIN stop s ON s.node=n.node""",
    "op13_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64*CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v,c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id%20=0 AND c.vec_id<>q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank<=20""",
}
