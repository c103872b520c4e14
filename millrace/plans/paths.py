"""Queries over paths, labels, files and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import paths as P
from millrace.plans import bindings as B
from millrace.plans.bindings import hash_sql, sql
from millrace.sources import files
from millrace.sources.scratch import temporary

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def quoted(values: tuple[str, ...]) -> str:
    return ",".join(f"'{v}'" for v in values)


NAME = "regexp_extract(path,'([^/]+)$',1)"
STEM = "regexp_replace(regexp_extract(path,'([^/]+)$',1),'\\.[^.]+$','')"
EXT = "lower(regexp_extract(path,'(\\.[^./]+)$',1))"
FOLDER = f"list_filter([CASE WHEN regexp_replace(lower(p),'[ -]','_','g') IN ({quoted(P.AI_FOLDERS)}) THEN 1 WHEN regexp_replace(lower(p),'[ -]','_','g') IN ({quoted(P.REAL_FOLDERS)}) THEN 0 END FOR p IN string_split(path,'/')], lambda x: x IS NOT NULL)[1]"


@query("p01_uid", "SELECT page_id, uid FROM (SELECT page_id, 'pages/shard-'||(page_id%4)||'/'||(row_number() OVER (PARTITION BY page_id%4 ORDER BY page_id)-1) AS uid FROM pages) WHERE page_id%17<>0")
def p01(spark, d):
    """Rows of shards on disk: file and place name a row, counting those that fail (no content here) and are dropped afterwards."""
    at = temporary(spark, "shards")
    body = F.when(F.col("page_id") % 17 != 0, F.col("html"))
    rows = B.read(spark, d, "pages").select("page_id", body.alias("html"), F.concat(F.lit("shard-"), (F.col("page_id") % 4).cast("string")).alias("shard"))
    files.write_shards(rows, at, "shard", ["page_id"]).agg(F.count("*")).collect()
    return files.scan_rows(spark, at, "pages").where("html is not null").select("page_id", "uid")


@query("p03_canon_version", sql("SELECT page_id, CASE WHEN page_id%2=0 THEN 'v1-crop256-q95' ELSE 'v2-resize256-q95' END AS canon_version FROM paths", "paths"))
def p03(spark, d):
    versions = F.create_map(F.lit("crop"), F.lit("v1-crop256-q95"), F.lit("resize"), F.lit("v2-resize256-q95"))
    mode = F.when(F.col("page_id") % 2 == 0, "crop").otherwise("resize")
    return B.paths(spark, d).select("page_id", versions[mode].alias("canon_version"))


def pads(s: str, a: str, b: str) -> str:
    return f"CAST(greatest(0,(256-{s}+1)//2) AS BIGINT) AS {a}, CAST(greatest(0,256-{s}-greatest(0,(256-{s}+1)//2)) AS BIGINT) AS {b}"


def draw(axis: str, s: str) -> str:
    return f"{hash_sql(f'(uid||{chr(39)}{axis}{chr(39)})', 42)}%(greatest({s},256)-256+1) AS {axis}"


@query("p04_crop_plan", sql(f"SELECT uid, w<256 OR h<256 AS was_padded, {pads('w', 'pad_l', 'pad_r')}, {pads('h', 'pad_t', 'pad_b')}, {draw('x', 'w')}, {draw('y', 'h')} FROM sizes", "sizes"))
def p04(spark, d):
    return P.crop_plan(B.sizes(spark, d))


RESIZED = "SELECT uid, greatest(256,CAST(round_even(w*(256.0::DOUBLE/least(w,h)),0) AS BIGINT)) AS new_w, greatest(256,CAST(round_even(h*(256.0::DOUBLE/least(w,h)),0) AS BIGINT)) AS new_h FROM sizes"


@query("p04_resize_plan", sql("SELECT *, (new_w-256)//2 AS left, (new_h-256)//2 AS top FROM r", "sizes", r=RESIZED))
def p04r(spark, d):
    return P.resize_plan(B.sizes(spark, d))


@query("p05_label_from_path", sql(f"SELECT page_id, {FOLDER} AS label FROM paths", "paths"))
def p05(spark, d):
    return B.paths(spark, d).select("page_id", P.label_from_path(F.col("path")).alias("label"))


RAW = "CASE page_id%5 WHEN 0 THEN ' AI ' WHEN 1 THEN 'Human' WHEN 2 THEN '1' WHEN 3 THEN 'authentic' ELSE 'maybe' END"


def raw_label():
    return F.element_at(F.array(*map(F.lit, (" AI ", "Human", "1", "authentic", "maybe"))), (F.col("page_id") % 5 + 1).cast("int"))


def norm_sql(raw: str) -> str:
    return f"CASE WHEN lower(trim({raw})) IN ({quoted(P.AI_LABELS)}) THEN 1 WHEN lower(trim({raw})) IN ({quoted(P.REAL_LABELS)}) THEN 0 END"


@query("p06_label_spelling", sql(f"SELECT page_id, {norm_sql(RAW)} AS label FROM paths", "paths"))
def p06(spark, d):
    return B.paths(spark, d).select("page_id", P.label_from_text(raw_label()).alias("label"))


CSV = f"SELECT {NAME} AS name, {STEM} AS stem, {norm_sql(RAW)} AS label, page_id AS row FROM paths WHERE page_id%3=2 AND page_id%4<2"
KEYS = "SELECT key, arg_max(label, row*2+s) AS label FROM (SELECT name AS key, label, row, 0 AS s FROM csv WHERE label IS NOT NULL UNION ALL SELECT stem, label, row, 1 FROM csv WHERE label IS NOT NULL) GROUP BY key"
PRECEDENCE = f"SELECT page_id, coalesce({FOLDER}, n.label, s.label) AS label FROM paths LEFT JOIN keys n ON n.key={NAME} LEFT JOIN keys s ON s.key={STEM}"


def csv_rows(spark, d):
    return B.paths(spark, d).where("page_id % 3 = 2 and page_id % 4 < 2").select(F.col("path").alias("id"), P.label_from_text(raw_label()).alias("label"), F.col("page_id").alias("row"))


@query("p07_label_precedence", sql(PRECEDENCE, "paths", csv=CSV, keys=KEYS))
def p07(spark, d):
    return P.resolved_labels(B.paths(spark, d), csv_rows(spark, d), F.lit(None).cast("int")).select("page_id", "label")


@query("j08_name_then_stem", sql(f"SELECT page_id, coalesce(n.label, s.label) AS label FROM paths LEFT JOIN keys n ON n.key={NAME} LEFT JOIN keys s ON s.key={STEM}", "paths", csv=CSV, keys=KEYS))
def j08(spark, d):
    return P.resolved_labels(B.paths(spark, d), csv_rows(spark, d), F.lit(None).cast("int")).select("page_id", F.coalesce("by_name", "by_stem").alias("label"))


@query("p08_path_parts", sql(f"SELECT page_id, {NAME} AS name, {STEM} AS stem, {EXT} AS ext, list_extract(string_split(path,'/'),-2) AS parent FROM paths", "paths"))
def p08(spark, d):
    p = F.col("path")
    return B.paths(spark, d).select("page_id", C.basename(p).alias("name"), C.stem(p).alias("stem"), C.extension(p).alias("ext"), C.parent(p, 1).alias("parent"))


@query("p09_path_hints", sql("SELECT page_id, coalesce(list_extract(q,-2),'') AS artist, coalesce(list_extract(q,-3),'') AS style, coalesce(list_extract(q,-4),'') AS genre, coalesce(list_extract(q,-5),'') AS none FROM (SELECT page_id, string_split(substr(path,2),'/') AS q FROM paths)", "paths"))
def p09(spark, d):
    p = F.col("path")
    return B.paths(spark, d).select("page_id", *[C.parent(p, k).alias(n) for k, n in ((1, "artist"), (2, "style"), (3, "genre"), (4, "none"))])


@query("p18_collision_names", sql(f"SELECT page_id, CASE WHEN k=0 THEN name ELSE stem||'__'||k||regexp_extract(name,'(\\.[^.]+)$',1) END AS link FROM (SELECT *, row_number() OVER (PARTITION BY class, name ORDER BY path, page_id)-1 AS k FROM (SELECT *, {NAME} AS name, {STEM} AS stem, coalesce({FOLDER},-1) AS class FROM paths))", "paths"))
def p18(spark, d):
    f = B.paths(spark, d).withColumn("class", F.coalesce(P.label_from_path(F.col("path")), F.lit(-1)))
    return P.collision_names(f, "class").select("page_id", "link")


FILED = "SELECT page_id, regexp_extract(path,'^/corpus/(.*/)[^/]*$',1)||page_id||regexp_extract(path,'(\\.[^.]+)$',1) AS name, strlen(html) AS bytes FROM paths JOIN pages USING (page_id)"


def page_files(spark, d) -> str:
    """Pages as files in folders by class and language, with several extensions; the folder they are in."""
    at, p = temporary(spark, "files"), F.col("path")
    name = F.concat(F.regexp_extract(p, "^/corpus/(.*/)[^/]*$", 1), F.col("page_id").cast("string"), F.regexp_extract(p, r"(\.[^.]+)$", 1))
    rows = B.paths(spark, d).join(B.read(spark, d, "pages").select("page_id", "html"), "page_id")
    files.write_files(rows.select(name.alias("name"), F.col("html").cast("binary").alias("body")), at).agg(F.count("*")).collect()
    return at


@query("s03_files_by_extension", sql(f"SELECT name, bytes FROM f WHERE lower(regexp_extract(name,'(\\.[^./]+)$',1)) IN ({quoted(P.IMAGE_TYPES)}) AND NOT starts_with(name,'misc/')", "paths", f=FILED))
def s03(spark, d):
    """A listing of files on disk; no content is read."""
    return files.listing(spark, page_files(spark, d), P.IMAGE_TYPES, ("Misc",)).select("name", "bytes")


@query("s11_checksums", "SELECT page_id, sha256(html) AS sha, page_id IN (SELECT doc_id FROM labels WHERE toxic=1) AS mismatch FROM pages WHERE page_id IN (SELECT doc_id FROM labels)")
def s11(spark, d):
    """Pages as files; the list of checksums names some that are missing and has wrong ones for some."""
    pages = B.read(spark, d, "pages").select("page_id", F.format_string("%012d.html", "page_id").alias("name"), F.col("html").cast("binary").alias("body"))
    at = temporary(spark, "pages")
    files.write_files(pages.select("name", "body"), at).agg(F.count("*")).collect()
    sha = F.sha2(F.col("body"), 256)
    known = B.read(spark, d, "labels").select(F.col("doc_id").alias("page_id"), "toxic")
    listed = known.join(pages, "page_id", "left").select(F.format_string("%012d.html", "page_id").alias("name"), F.when(F.col("toxic") == 1, F.reverse(sha)).otherwise(sha).alias("want"))
    checked = files.check_sums(spark, at, "*.html", listed)
    return checked.select(F.regexp_extract("name", "([0-9]+)[.]html", 1).cast("long").alias("page_id"), "sha", "mismatch")


def inventoried(spark, d):
    found = files.listing(spark, page_files(spark, d))
    return P.inventory(found.select(F.get(F.split("name", "/"), F.lit(0)).alias("dataset"), "bytes", "modified"))


@query("s12_inventory", sql("SELECT split_part(name,'/',1) AS dataset, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes)/1e9,9) AS gb, TRUE AS timed FROM f GROUP BY 1", "paths", f=FILED))
def s12(spark, d):
    return inventoried(spark, d).select("dataset", "files", "bytes", "gb", (F.col("mb_per_s") > 0).alias("timed"))


@query("s12_rates")
def s12_rates(spark, d):
    """With the rate, which the files' own times decide and no SQL can know; a test sets the times."""
    return inventoried(spark, d)


@query("a24_group_verdict", sql("""SELECT artist, top_path, CASE WHEN share=1 THEN 'Yes' WHEN share=0 THEN 'No' ELSE 'Mixed' END AS verdict FROM (SELECT split_part(path,'/',4) AS artist, arg_max(path, p*1000000-page_id) AS top_path, avg(CASE WHEN p>=0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS share FROM q GROUP BY 1)""", "paths", q="SELECT *, (page_id*7919%100)/100.0::DOUBLE AS p FROM paths"))
def a24(spark, d):
    p = B.paths(spark, d).withColumn("p", F.col("page_id") * 7919 % 100 / 100.0)
    g = p.groupBy(F.get(F.split("path", "/"), F.lit(3)).alias("artist")).agg(F.max_by("path", F.struct("p", -F.col("page_id"))).alias("top_path"), F.avg((F.col("p") >= 0.5).cast("double")).alias("share"))
    return g.select("artist", "top_path", F.when(F.col("share") == 1, "Yes").when(F.col("share") == 0, "No").otherwise("Mixed").alias("verdict"))
