"""Queries over raster tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import dedup, images, palette
from millrace.operators import raster as R
from millrace.plans import bindings as B
from millrace.plans.bindings import hash_sql, sql
from millrace.sources import files
from millrace.sources.scratch import cut, temporary

QUERIES, ORACLES = {}, {}
LEVELS = (0.0, 0.1, 0.25, 0.5)


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def tiles(spark, d) -> DataFrame:
    return R.tile_rows(B.tiles(spark, d))


def mirror(e: str) -> str:
    return f"CASE WHEN abs({e})>7 THEN 14-abs({e}) ELSE abs({e}) END"


def taps_sql(taps) -> str:
    return "SELECT * FROM (VALUES " + ",".join(f"({dy},{dx},{w!r}::DOUBLE)" for dy, dx, w in taps) + ") t(dy,dx,w)"


def conv_sql(kernel: str, src: str = "tiles") -> str:
    return f"SELECT p.img, p.y, p.x, any_value(p.v) AS v, sum(k.w*q.v) AS s FROM {src} p, {kernel} k JOIN {src} q ON q.img=p.img AND q.y={mirror('p.y+k.dy')} AND q.x={mirror('p.x+k.dx')} GROUP BY p.img, p.y, p.x"


RGB_STATS = "SELECT img, " + ", ".join(f"round(avg({c}/255.0::DOUBLE),6) AS mean_{c}, round(stddev_pop({c}/255.0::DOUBLE),6) AS std_{c}" for c in "rgb") + ", round(avg((r/255.0::DOUBLE+g/255.0::DOUBLE+b/255.0::DOUBLE)/3),6) AS brightness FROM rgb GROUP BY img"
COLOUR = dict(raw=B.CTE["tiles"], rgb=B.CTE["rgb"])


@query("r01_pixel_stats", sql(RGB_STATS, **COLOUR))
def r01(spark, d):
    return R.channel_stats(B.rgb_tiles(spark, d))


@query("r02_noise_residual", sql("SELECT img, round(avg(v-s),6) AS mean, round(stddev_pop(v-s),6) AS std, round(avg((v-s)*(v-s)),6) AS energy FROM c GROUP BY img", "tiles", k=taps_sql(R.normalized(R.GAUSS_5)), c=conv_sql("k")))
def r02(spark, d):
    return R.moments(R.residual(tiles(spark, d), R.GAUSS_5))


SPECTRUM = """SELECT img, sum(m) FILTER (NOT far) AS low, sum(m) FILTER (far) AS high FROM (SELECT img, u, w, sqrt(sum(v*cos(2*pi()*(u*y+w*x)/8))**2+sum(v*sin(2*pi()*(u*y+w*x)/8))**2) AS m,
 sqrt(CAST(((u+4)%8-4)**2+((w+4)%8-4)**2 AS DOUBLE))>1 AS far FROM tiles, range(8) a(u), range(8) b(w) GROUP BY img, u, w) GROUP BY img"""


@query("r03_spectrum", sql("SELECT img, round(high/(low+high+1e-8),6) AS fft_high, round(low/(low+high+1e-8),6) AS fft_low, round(high/(low+1e-8),6) AS fft_ratio FROM f", "tiles", f=SPECTRUM))
def r03(spark, d):
    return R.spectrum(tiles(spark, d))


PAIRS = " UNION ALL ".join(f"SELECT p.img, {a} AS angle, p.v//4 AS i, q.v//4 AS j FROM tiles p JOIN tiles q ON q.img=p.img AND q.y=p.y+({dy}) AND q.x=p.x+({dx})" for a, (dy, dx) in R.ANGLES.items())
GLCM = "SELECT img, angle, i, j, CAST(count(*) AS DOUBLE) AS n FROM (SELECT * FROM one UNION ALL SELECT img, angle, j, i FROM one) GROUP BY ALL"
GLCM2 = "SELECT img, angle, sum(n*(i-j)*(i-j))/sum(n) AS contrast, sqrt(sum(n*n))/sum(n) AS energy, sum(n/(1+(i-j)*(i-j)))/sum(n) AS homogeneity, CASE WHEN sum(n*i*i)/sum(n)-(sum(n*i)/sum(n))**2<1e-15 THEN 1.0::DOUBLE ELSE (sum(n*i*j)/sum(n)-(sum(n*i)/sum(n))**2)/(sum(n*i*i)/sum(n)-(sum(n*i)/sum(n))**2) END AS correlation FROM g GROUP BY img, angle"


@query("r05_cooccurrence", sql("SELECT img, round(avg(contrast),6) AS contrast, round(avg(energy),6) AS energy, round(avg(homogeneity),6) AS homogeneity, round(avg(correlation),6) AS correlation FROM m GROUP BY img", "tiles", one=PAIRS, g=GLCM, m=GLCM2))
def r05(spark, d):
    return R.cooccurrence(tiles(spark, d))


@query("r06_gradients", sql("SELECT img, round(avg(m),6) AS sobel_mean, round(stddev_pop(m),6) AS sobel_std, round(avg(CASE WHEN m>=150 THEN 1.0::DOUBLE ELSE 0 END),6) AS gradient_density FROM (SELECT a.img, sqrt(a.s*a.s+b.s*b.s) AS m FROM gx a JOIN gy b ON a.img=b.img AND a.y=b.y AND a.x=b.x) GROUP BY img", "tiles", kx=taps_sql(R.SOBEL_X), ky=taps_sql(R.SOBEL_Y), gx=conv_sql("kx"), gy=conv_sql("ky")))
def r06(spark, d):
    return R.gradients(tiles(spark, d))


@query("r08_palette", sql("SELECT img, round(log2(sum(n))-sum(n*log2(n))/sum(n),6) AS entropy, arg_max(code, n*100-code) AS dominant FROM (SELECT img, CAST(v//32 AS BIGINT) AS code, CAST(count(*) AS DOUBLE) AS n FROM tiles GROUP BY ALL) GROUP BY img", "tiles"))
def r08(spark, d):
    return R.palette(tiles(spark, d))


_TURN = "CASE WHEN m=r THEN CASE WHEN g<b THEN (g-b)/CAST(m-l AS DOUBLE)+6 ELSE (g-b)/CAST(m-l AS DOUBLE) END WHEN m=g THEN (b-r)/CAST(m-l AS DOUBLE)+2 ELSE (r-g)/CAST(m-l AS DOUBLE)+4 END"
COLOURS = f"""SELECT img, round(log2(sum(n))-sum(n*log2(n))/sum(n),6) AS palette_entropy, CAST(arg_max(code, n*100-code)//16*64+32 AS DOUBLE) AS dominant_r, CAST(arg_max(code, n*100-code)//4%4*64+32 AS DOUBLE) AS dominant_g, CAST(arg_max(code, n*100-code)%4*64+32 AS DOUBLE) AS dominant_b, any_value(h) AS hue_std
 FROM (SELECT img, r//64*16+g//64*4+b//64 AS code, CAST(count(*) AS DOUBLE) AS n FROM rgb GROUP BY ALL) JOIN (SELECT img, round(coalesce(stddev_pop(CASE WHEN m>l THEN ({_TURN})/6.0::DOUBLE END),0),6) AS h FROM (SELECT *, greatest(r,g,b) AS m, least(r,g,b) AS l FROM rgb) GROUP BY img) USING (img) GROUP BY img"""


@query("r08_colours", sql(COLOURS, **COLOUR))
def r08_colours(spark, d):
    return R.colours(B.rgb_tiles(spark, d))


ORDERED = f"SELECT y, x, row_number() OVER (ORDER BY {hash_sql('CAST(y*8+x AS VARCHAR)', 42)})-1 AS k FROM (SELECT DISTINCT y, x FROM tiles)"
NOISED = "SELECT t.img, t.label, l.level, t.y, t.x, CASE WHEN o.k<CAST(round_even(64*l.level,0) AS INT)//2 THEN 255 WHEN o.k<CAST(round_even(64*l.level,0) AS INT) THEN 0 ELSE t.v END AS v FROM tiles t JOIN ordered o USING (y, x), (VALUES (0.0::DOUBLE),(0.1::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE)) l(level)"


def levelled(spark, d) -> DataFrame:
    t = tiles(spark, d)
    out = None
    for level in LEVELS:
        part = R.salted(t, level).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


@query("r09_salt_and_pepper", sql("SELECT img, level, round(avg(v),6) AS mean FROM n GROUP BY ALL", "tiles", ordered=ORDERED, n=NOISED))
def r09(spark, d):
    return levelled(spark, d).select("img", "level", F.round(R.mean(F.col("v")), 6).alias("mean"))


BLURS = {1: R.GAUSS_3, 2: R.GAUSS_5, 3: R.GAUSS_9}


@query("r09_gaussian_blur", sql(" UNION ALL ".join(f"SELECT img, {n} AS level, round(avg(s),6) AS mean, round(stddev_pop(s),6) AS std FROM c{n} GROUP BY img" for n in BLURS), "tiles", **{f"k{n}": taps_sql(R.normalized(k)) for n, k in BLURS.items()}, **{f"c{n}": conv_sql(f"k{n}") for n in BLURS}))
def r09_blur(spark, d):
    """Three widths of Gaussian blur."""
    t, out = tiles(spark, d), None
    for n, taps in BLURS.items():
        part = R.moments(R.blurred(t, taps)).select("img", F.lit(n).alias("level"), "mean", "std")
        out = part if out is None else out.unionByName(part)
    return out


@query("j13_levels_by_sample", sql("SELECT img, level FROM (SELECT DISTINCT img FROM tiles), (VALUES (0.0::DOUBLE),(0.1::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE)) l(level)", "tiles"))
def j13(spark, d):
    levels = spark.createDataFrame([(x,) for x in LEVELS], "level double")
    return B.read(spark, d, "embeddings").select(F.col("vec_id").alias("img")).crossJoin(F.broadcast(levels))


SCORED = "SELECT img, level, CASE WHEN avg(v)>=128 THEN 1 ELSE 0 END AS pred, any_value(label)%2 AS y FROM n GROUP BY img, level"
ACC = "SELECT level, round(avg(CASE WHEN pred=y THEN 1.0::DOUBLE ELSE 0 END),6) AS accuracy FROM s GROUP BY level"


def scored(spark, d) -> DataFrame:
    truth = B.read(spark, d, "embeddings").select(F.col("vec_id").alias("img"), (F.col("label") % 2).alias("y"))
    return levelled(spark, d).select("img", "level", (R.mean(F.col("v")) >= 128).cast("int").alias("pred")).join(truth, "img")


def accuracy(spark, d) -> DataFrame:
    return scored(spark, d).groupBy("level").agg(F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 6).alias("accuracy"))


@query("a22_accuracy_by_level", sql(ACC, "tiles", ordered=ORDERED, n=NOISED, s=SCORED))
def a22(spark, d):
    return accuracy(spark, d)


@query("w11_degradation_cliff", sql("SELECT level, round(abs(accuracy-lag(accuracy) OVER (ORDER BY level)),6) AS jump FROM a QUALIFY lag(accuracy) OVER (ORDER BY level) IS NOT NULL ORDER BY jump DESC, level LIMIT 1", "tiles", ordered=ORDERED, n=NOISED, s=SCORED, a=ACC))
def w11(spark, d):
    jump = F.round(F.abs(F.col("accuracy") - F.lag("accuracy").over(Window.orderBy("level"))), 6)
    return accuracy(spark, d).withColumn("jump", jump).where("jump is not null").orderBy(F.desc("jump"), "level").limit(1).select("level", "jump")


@query("a26_f1_by_level", sql("SELECT level, round(coalesce(2.0::DOUBLE*count(*) FILTER (pred=1 AND y=1)/nullif(2*count(*) FILTER (pred=1 AND y=1)+count(*) FILTER (pred<>y),0),0),6) AS f1 FROM s GROUP BY level", "tiles", ordered=ORDERED, n=NOISED, s=SCORED))
def a26(spark, d):
    tp = F.count_if((F.col("pred") == 1) & (F.col("y") == 1))
    wrong = F.count_if(F.col("pred") != F.col("y"))
    return scored(spark, d).groupBy("level").agg(F.round(F.coalesce(F.try_divide(2.0 * tp, 2 * tp + wrong), F.lit(0.0)), 6).alias("f1"))


def kernel(size: int) -> list[tuple[int, int, float]]:
    """Gaussian of a kernel size, with the deviation that goes with it by convention."""
    sigma, reach = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    return R.normalized([(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])


KERNELS = (0, 3, 5, 7, 11)
GRID_SQL = " UNION ALL ".join(f"SELECT img, {k} AS kernel, round(avg({'s' if k else 'v'}),6) AS mean, round(stddev_pop({'s' if k else 'v'}),6) AS std FROM {f'c{k}' if k else 'tiles'} GROUP BY img" for k in KERNELS)
VOTED = "SELECT kernel, 'mean' AS model, CAST(mean>=128 AS INT) AS pred, y FROM g JOIN t USING (img) UNION ALL SELECT kernel, 'contrast', CAST(std>=20 AS INT), y FROM g JOIN t USING (img)"


@query("a26_f1_by_blur", sql("SELECT kernel, model, count(*) FILTER (pred=1 AND y=1) AS tp, round(coalesce(2.0::DOUBLE*count(*) FILTER (pred=1 AND y=1)/nullif(2*count(*) FILTER (pred=1 AND y=1)+count(*) FILTER (pred<>y),0),0),6) AS f1 FROM o GROUP BY kernel, model", "tiles", **{f"k{k}": taps_sql(kernel(k)) for k in KERNELS if k}, **{f"c{k}": conv_sql(f"k{k}") for k in KERNELS if k}, g=GRID_SQL, t="SELECT DISTINCT img, label%2 AS y FROM tiles", o=VOTED))
def a26_blur(spark, d):
    """Two models over five kernels of blur: each kernel's pixels are worked out once and both models score them."""
    t, grid = cut(tiles(spark, d)), None
    for k in KERNELS:
        part = R.moments(R.blurred(t, kernel(k)) if k else t).select("img", F.lit(k).alias("kernel"), "mean", "std")
        grid = part if grid is None else grid.unionByName(part)
    truth = B.read(spark, d, "embeddings").select(F.col("vec_id").alias("img"), (F.col("label") % 2).alias("y"))
    votes = F.inline(F.array(F.struct(F.lit("mean").alias("model"), (F.col("mean") >= 128).cast("int").alias("pred")), F.struct(F.lit("contrast").alias("model"), (F.col("std") >= 20).cast("int").alias("pred"))))
    tp, wrong = F.count_if((F.col("pred") == 1) & (F.col("y") == 1)), F.count_if(F.col("pred") != F.col("y"))
    scored = grid.join(truth, "img").select("kernel", "y", votes)
    return scored.groupBy("kernel", "model").agg(tp.alias("tp"), F.round(F.coalesce(F.try_divide(2.0 * tp, 2 * tp + wrong), F.lit(0.0)), 6).alias("f1"))


NOISE = dict(g="SELECT img, y, x, v/255.0::DOUBLE AS v FROM tiles", k9=taps_sql(R.normalized(R.GAUSS_9)), c9=conv_sql("k9", "g"), q="SELECT img, y, x, (v-s)/(v+1e-3::DOUBLE) AS v FROM c9", k3=taps_sql(R.normalized(R.GAUSS_3)), c3=conv_sql("k3", "q"), z="SELECT img, y, x, v-s AS v FROM c3")


@query("r04_sensor_noise", sql("SELECT img, mean, std, energy, round(high/(low+1e-8),6) AS fft_ratio FROM (SELECT img, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(avg(v*v),6) AS energy FROM z GROUP BY img) JOIN f USING (img)", "tiles", **NOISE, f=SPECTRUM.replace("FROM tiles,", "FROM z,")))
def r04(spark, d):
    z = R.sensor_noise(tiles(spark, d))
    return R.moments(z).join(R.spectrum(z).select("img", "fft_ratio"), "img")


PEAK = "SELECT img, round(max(abs(c)) FILTER (dy<>0 OR dx<>0)/(max(c) FILTER (dy=0 AND dx=0)+1e-8),6) AS peak FROM (SELECT p.img, a.dy, b.dx, sum(p.v*q.v) AS c FROM n p, range(8) a(dy), range(8) b(dx) JOIN n q ON q.img=p.img AND q.y=(p.y+a.dy)%8 AND q.x=(p.x+b.dx)%8 GROUP BY ALL) GROUP BY img"


@query("r04_autocorrelation", sql(PEAK, "tiles", n="SELECT img, y, x, v-avg(v) OVER (PARTITION BY img) AS v FROM tiles"))
def r04_peak(spark, d):
    return R.autocorrelation_peak(tiles(spark, d))


def lin(c: str) -> str:
    return f"CASE WHEN {c}/255.0::DOUBLE<=0.04045::DOUBLE THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE,2.4::DOUBLE) END"


def lab(t: str) -> str:
    return f"CASE WHEN {t}>0.008856::DOUBLE THEN cbrt({t}) ELSE {t}*7.787::DOUBLE+16.0::DOUBLE/116 END"


LINEAR = f"SELECT img, {lin('r')} AS r, {lin('g')} AS g, {lin('b')} AS b FROM rgb"
XYZ = "SELECT img, (r*0.412453::DOUBLE+g*0.357580::DOUBLE+b*0.180423::DOUBLE)/0.950456::DOUBLE AS x, r*0.212671::DOUBLE+g*0.715160::DOUBLE+b*0.072169::DOUBLE AS y, (r*0.019334::DOUBLE+g*0.119193::DOUBLE+b*0.950227::DOUBLE)/1.088754::DOUBLE AS z FROM lin"
CHROMA = f"SELECT img, sqrt(pow(500*({lab('x')}-{lab('y')}),2)+pow(200*({lab('y')}-{lab('z')}),2))/181 AS c FROM xyz"


@query("r07_chroma", sql("SELECT img, round(avg(c),6) AS chroma_mean, round(stddev_pop(c),6) AS chroma_std, round(quantile_cont(c,0.9),6) AS chroma_p90 FROM ch GROUP BY img", **COLOUR, lin=LINEAR, xyz=XYZ, ch=CHROMA))
def r07(spark, d):
    return R.chroma(B.rgb_tiles(spark, d))


def on_grey(query: str) -> str:
    """The SQL of a query over grey tiles (or its name), over the luma of the colour tiles instead."""
    return ORACLES.get(query, query).replace(f"tiles AS ({B.CTE['tiles']})", f"raw AS ({B.CTE['tiles']}), rgb AS ({B.CTE['rgb']}), tiles AS ({B.CTE['grey']})")


#: The columns of the feature job: query, or its form over the luma, and names there and in the job.
SAME = lambda *names: {n: n for n in names}
JOB = {
    ORACLES["r01_pixel_stats"]: SAME("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "brightness"), on_grey("r02_noise_residual"): {"mean": "noise_mean", "std": "noise_std", "energy": "noise_energy"}, on_grey("r03_spectrum"): SAME("fft_high", "fft_low", "fft_ratio"),
    on_grey("r04_sensor_noise"): {"mean": "prnu_mean", "std": "prnu_std", "energy": "prnu_energy", "fft_ratio": "prnu_fft_ratio"}, on_grey("r05_cooccurrence"): SAME("contrast", "energy", "homogeneity", "correlation"), on_grey("r06_gradients"): SAME("sobel_mean", "sobel_std", "gradient_density"),
    on_grey(sql(PEAK, "tiles", **NOISE, n="SELECT img, y, x, v-avg(v) OVER (PARTITION BY img) AS v FROM z")): {"peak": "prnu_peak"}, ORACLES["r07_chroma"]: SAME("chroma_mean", "chroma_std", "chroma_p90"), ORACLES["r08_colours"]: SAME("palette_entropy", "dominant_r", "dominant_g", "dominant_b", "hue_std"),
}
JOINED = " JOIN ".join(f"(SELECT img, {', '.join(f'{a} AS f_{b}' for a, b in names.items())} FROM ({q})) t{i}" + (" USING (img)" if i else "") for i, (q, names) in enumerate(JOB.items()))


def image_files(spark, d) -> DataFrame:
    """The colour tiles as PNG files, one in seventeen cut off, read again."""
    at = temporary(spark, "images")
    images.write_tiles(B.rgb_tiles(spark, d), at)
    return images.extract(files.read_images(spark, at, drop=None))


@query("r10_feature_job", f"SELECT img, {', '.join(f'f_{n}' for n in images.NAMES)} FROM {JOINED} WHERE img%17<>0")
def r10(spark, d):
    """All 33 features of all image files that can be decoded."""
    rows = image_files(spark, d).where("not failed")
    return rows.select(number_of().alias("img"), *[f"f_{n}" for n in images.NAMES])


@query("r10_failures", sql("SELECT count(*) AS images, count(*) FILTER (img%17=0) AS failures FROM (SELECT DISTINCT img FROM rgb)", **COLOUR))
def r10_failures(spark, d):
    return image_files(spark, d).agg(F.count("*").alias("images"), F.count_if("failed").alias("failures"))


WEIGHTS = "SELECT u, y, sum(cos(pi()*u*(2*(4*y+r)+1)/64)) AS c FROM range(8) a(u), range(8) b(y), range(4) e(r) GROUP BY ALL"
COEFFICIENTS = "SELECT img, a.u, b.u AS w, round(sum(v*a.c*b.c),4) AS c FROM {src} t JOIN wt a ON a.y=t.y JOIN wt b ON b.y=t.x GROUP BY img, a.u, b.u"
SIGNED = "SELECT img, CAST(sum(CASE WHEN c>m THEN CASE WHEN u=0 AND w=0 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT<<CAST(63-8*u-w AS INT) END ELSE 0 END) AS BIGINT) AS sig FROM co JOIN (SELECT img, median(c) AS m FROM co GROUP BY img) USING (img) GROUP BY img"


@query("c06_tile_signature", sql("SELECT img, sig FROM sg", "tiles", wt=WEIGHTS, co=COEFFICIENTS.format(src="tiles"), sg=SIGNED))
def c06_tiles(spark, d):
    return R.signature(tiles(spark, d))


def number_of() -> Column:
    return F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long")


@query("c06_image_signature", sql("SELECT img, CASE WHEN img%17<>0 THEN sig END AS sig FROM sg", **COLOUR, grey=B.CTE["grey"], wt=WEIGHTS, co=COEFFICIENTS.format(src="grey"), sg=SIGNED))
def c06_images(spark, d):
    """Signatures of PNG files; those cut off have none."""
    at = temporary(spark, "images")
    images.write_tiles(B.rgb_tiles(spark, d), at)
    return images.signatures(files.read_images(spark, at, drop=None)).select(number_of().alias("img"), "sig")


#: Copies of an image: as it is, brighter, and with fewer levels. SQL and column form.
COPIES = {"{c}": lambda c: c, "least(255,{c}+12)": lambda c: F.least(F.lit(255), c + 12), "{c}//16*16+8": lambda c: F.floor(c / 16) * 16 + 8}
COPIED = " UNION ALL ".join(f"SELECT img*3+{k} AS img, y, x, {', '.join(e.format(c=c) + ' AS ' + c for c in 'rgb')} FROM rgb" for k, e in enumerate(COPIES))


def copied(pixels: DataFrame) -> DataFrame:
    """Every image of pixels (img, y, x, r, g, b) in all its COPIES, from one pass over them."""
    forms = [F.struct((F.col("img") * 3 + k).alias("img"), "y", "x", *[change(F.col(c)).cast("int").alias(c) for c in "rgb"]) for k, change in enumerate(COPIES.values())]
    return pixels.select(F.explode(F.array(*forms)).alias("p")).select("p.*")


@query("c06_near_images", sql("SELECT b.img, b.sig, NOT EXISTS (SELECT 1 FROM sg a WHERE a.img<b.img AND bit_count(xor(a.sig,b.sig))<=4) AS kept FROM sg b", **COLOUR, cp=COPIED, gr=B.CTE["grey"].replace("FROM rgb", "FROM cp"), wt=WEIGHTS, co=COEFFICIENTS.format(src="gr"), sg=SIGNED))
def c06_near(spark, d):
    """Near-duplicate images among PNG files of all colour tiles and two copies of each: the first of those within four bits stays."""
    at = temporary(spark, "copies")
    images.write_tiles(copied(B.rgb_tiles(spark, d)), at, broken=None)
    signed = cut(images.signatures(files.read_images(spark, at)).select(number_of().alias("doc_id"), "sig"))
    return dedup.keep_first(signed).select(F.col("doc_id").alias("img"), "sig", "kept")


@query("r08_codebook")
def r08_codebook(spark, d):
    """Palette of each colour tile over one codebook of all of them; tests compare with a plain assignment to the same centres."""
    p = cut(B.rgb_tiles(spark, d))
    return palette.palettes(p, palette.codebook(p))
