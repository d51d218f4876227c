"""Queries that run the detectors' pixel path at real sizes, each with SQL for the same rows.

Every supplier is an image of 96 x 72 colored pixels whose values are a formula of its
key and of the pixel's place.  Resampling, gray conversion, edges, hashes and scores are
those of the audit's one Arrow pass; SQL works them out from the pixels again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import properties
from ..schema import COLUMNS, DEFAULTS, IMAGE, PERCENTILES
from .queries import query, table

WIDTH, HEIGHT = 96, 72
#: Images that are drawn and handed on at once.
DRAWN = 64


def color_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of WIDTH x HEIGHT pixels in Spark's row type."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[0:HEIGHT, 0:WIDTH]
        for b in batches:
            for lo in range(0, len(b), DRAWN):
                keys, images = b["s_suppkey"].iloc[lo : lo + DRAWN], []
                for k in keys.tolist():
                    plane = k * 37 + x * (2 + k % 5) + y * (1 + k % 7) + x * y * (1 + k % 3) // 16
                    bgr = np.stack([(plane + c * (11 + k % 13)) % 256 for c in (2, 1, 0)], axis=2).astype(np.uint8)
                    images.append({"origin": "", "height": HEIGHT, "width": WIDTH, "nChannels": 3, "mode": 16, "data": bgr.tobytes()})
                yield pd.DataFrame({"image_id": keys.to_numpy(), "image": images})

    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"))
    drawn = keys.repartition(spark.sparkContext.defaultParallelism).mapInPandas(draw, f"image_id long, image {IMAGE}")
    return drawn.select("image_id", F.col("image_id").alias("ord"), F.lit("").alias("name"), "image")


_PX = f"""p0 AS (SELECT CAST(s_suppkey AS BIGINT) AS id, y, x FROM supplier, range({HEIGHT}) AS ys(y), range({WIDTH}) AS xs(x)),
p1 AS (SELECT id, y, x, id * 37 + x * (2 + id % 5) + y * (1 + id % 7) + x * y * (1 + id % 3) // 16 AS v, 11 + id % 13 AS s FROM p0),
px AS (SELECT id, y, x, v % 256 AS r, (v + s) % 256 AS g, (v + 2 * s) % 256 AS b FROM p1)"""

_TO_GRAY = "(r * 19595 + g * 38470 + b * 7471 + 32768) // 65536"
_GRAY = f"{_PX}, gray AS (SELECT id, y, x, {_TO_GRAY} AS v FROM px)"


def _weights(name: str, size: int, to: int, kind: str) -> str:
    """CTEs that end in ``name`` (i, j, w): integer weights of input j in output i."""
    scale = size / to
    wide, support = max(scale, 1.0), {"bicubic": 2.0, "lanczos": 3.0}[kind]
    f = {
        "bicubic": "CASE WHEN abs(t) < 1 THEN (1.5 * abs(t) - 2.5) * t * t + 1 WHEN abs(t) < 2 THEN ((-0.5 * abs(t) + 2.5) * abs(t) - 4) * abs(t) + 2 ELSE 0 END",
        "lanczos": "CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END",
    }[kind]
    return f"""{name}_c AS (SELECT i, (i + 0.5::DOUBLE) * {scale!r}::DOUBLE AS c FROM range({to}) AS r(i)),
{name}_t AS (SELECT i, j, (j - c + 0.5::DOUBLE) / {wide!r}::DOUBLE AS t FROM {name}_c, range({size}) AS q(j)
  WHERE j >= greatest(trunc(c - {support * wide!r}::DOUBLE + 0.5::DOUBLE), 0) AND j < least(trunc(c + {support * wide!r}::DOUBLE + 0.5::DOUBLE), {size})),
{name}_f AS (SELECT i, j, CAST({f} AS DOUBLE) AS f FROM {name}_t),
{name}_n AS (SELECT i, j, f / sum(f) OVER (PARTITION BY i) * 4194304 AS u FROM {name}_f),
{name} AS (SELECT i, j, CAST(trunc(CASE WHEN u < 0 THEN u - 0.5::DOUBLE ELSE u + 0.5::DOUBLE END) AS BIGINT) AS w FROM {name}_n)"""


def _rounded(sums: str) -> str:
    return f"CAST(greatest(0, least(255, floor((CAST({sums} AS DOUBLE) + 2097152) / 4194304))) AS BIGINT)"


def _resized(source: str, out: str, width: int, height: int, kind: str, bands: str = "v") -> str:
    """CTEs that end in ``out`` (id, y, x and bands): ``source`` in another size, rows first."""
    across = ", ".join(f"{_rounded(f'sum(w * {b})')} AS {b}" for b in bands)
    return f"""{_weights(f"{out}_wx", WIDTH, width, kind)}, {_weights(f"{out}_wy", HEIGHT, height, kind)},
{out}_h AS (SELECT id, y, i AS x, {across} FROM {source} JOIN {out}_wx ON x = j GROUP BY id, y, i),
{out} AS (SELECT id, i AS y, x, {across} FROM {out}_h JOIN {out}_wy ON y = j GROUP BY id, i, x)"""


_COLOR = ", ".join(f"round(quantile_cont(l, {p / 100}), 6) AS brightness_perc_{p}" for p in PERCENTILES)


@query(f"""WITH {_PX}, lum AS (SELECT id, sqrt(0.241 * r * r + 0.691 * g * g + 0.068 * b * b) / 255 AS l, r, g, b FROM px),
a AS (SELECT id, {_COLOR}, quantile_cont(l, 0.99) AS p99, quantile_cont(l, 0.05) AS p5, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM lum GROUP BY id),
v AS (SELECT id, 0 AS k, r AS v FROM px UNION ALL SELECT id, 1, g FROM px UNION ALL SELECT id, 2, b FROM px), n AS (SELECT id, k, v, count(*) / {3.0 * WIDTH * HEIGHT} AS p FROM v GROUP BY id, k, v),
e AS (SELECT id, -sum(p * log2(p)) AS e FROM n GROUP BY id)
SELECT a.id AS image_id, a.* EXCLUDE (id, r, g, b, p99, p5), round(sqrt(0.241 * r * r + 0.691 * g * g + 0.068 * b * b) / 255, 6) AS brightness, round(e, 6) AS entropy,
  'RGB' AS color_space, {HEIGHT / WIDTH!r}::DOUBLE AS aspect_ratio, round(sqrt({WIDTH * HEIGHT}.0), 6)::DOUBLE AS size, p99 < 0.32 AS is_dark_issue, 1 - p5 < 0.05 AS is_light_issue, least(1.0, 0.1 * e) < 0.3 AS is_low_information_issue, false AS is_grayscale_issue
FROM a JOIN e ON a.id = e.id""")
def color_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property of one pass but sharpness, and the flags that follow from them."""
    df = properties.compute(color_rasters(spark, sf_dir), ["brightness", "entropy", "color_space", "aspect_ratio", "size"])
    limit = lambda t: DEFAULTS[t].get("threshold", 0.5)
    flags = {f"is_{t}_issue": scores.flag(scores.SCORES[t](DEFAULTS[t]), limit(t)) for t in ("dark", "light", "low_information", "grayscale")}
    numbers = {c: F.round(c, 6) for c in [*COLUMNS["brightness"], "entropy", "aspect_ratio", "size"]}
    return df.withColumns(flags).withColumns(numbers).drop("ord", "name")


@query(f"""WITH {_PX} SELECT id AS image_id, md5(unhex(string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY y, x))) AS md5 FROM px GROUP BY id""")
def image_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.compute(color_rasters(spark, sf_dir), hashes=[("md5", None)]).select("image_id", "md5")


_SMALL_W, _SMALL_H = 64, 48


@query(f"""WITH {_PX}, {_resized("px", "sm", _SMALL_W, _SMALL_H, "bicubic", "rgb")}, f AS (SELECT id, y, x, {_TO_GRAY} AS v FROM sm),
n AS (SELECT f.id, f.y, f.x, any_value(f.v) AS v, sum(q.v) AS s FROM f JOIN (SELECT id, y + dy AS y, x + dx AS x, v FROM f, range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)) AS q ON f.id = q.id AND f.y = q.y AND f.x = q.x GROUP BY f.id, f.y, f.x),
e AS (SELECT id, CASE WHEN y IN (0, {_SMALL_H - 1}) OR x IN (0, {_SMALL_W - 1}) THEN v ELSE greatest(0, least(255, 9 * v - s)) END AS e FROM n),
b AS (SELECT id, sqrt(var_pop(e)) AS blurriness FROM e GROUP BY id),
h AS (SELECT id, sqrt(sum(c * c) / 256.0 - pow({_SMALL_W * _SMALL_H} / 256.0, 2)) AS spread FROM (SELECT id, v, count(*) AS c FROM f GROUP BY id, v) AS k GROUP BY id),
z AS (SELECT b.id, blurriness, spread, least(1.0, 1 - exp(-0.01 * blurriness) + CASE WHEN 1 - exp(-0.01 * spread) <= 0.18 THEN 0 ELSE 1 - exp(-0.01 * spread) END) AS score FROM b JOIN h ON b.id = h.id)
SELECT id AS image_id, round(blurriness, 6) AS blurriness, round(spread, 6) AS blurriness_grayscale_std, round(score, 6) AS blurry_score, score < 0.29 AS is_blurry_issue FROM z""")
def resized_blurry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = DEFAULTS["blurry"]
    df = properties.compute(color_rasters(spark, sf_dir), ["blurriness"]).withColumns({"blurry_score": scores.blur_score(p), "is_blurry_issue": scores.flag(scores.blur_score(p), p["threshold"])})
    return df.withColumns({c: F.round(c, 6) for c in ("blurriness", "blurriness_grayscale_std", "blurry_score")}).drop("ord", "name")


def _hash(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = properties.compute(color_rasters(spark, sf_dir), hashes=[(kind, 8)])
    return df.select("image_id", F.lpad(F.conv(f"{kind}_8", 16, 2), 64, "0").alias(kind))


def _bits(test: str, kind: str, source: str = "k", order: str = "y, x") -> str:
    return f"SELECT id AS image_id, string_agg(CASE WHEN {test} THEN '1' ELSE '0' END, '' ORDER BY {order}) AS {kind} FROM {source} GROUP BY id"


@query(f"WITH {_GRAY}, {_resized('gray', 'sm', 8, 8, 'lanczos')}, k AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m FROM sm) {_bits('v > m', 'ahash')}")
def resampled_ahash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash(spark, sf_dir, "ahash")


@query(f"WITH {_GRAY}, {_resized('gray', 'sm', 9, 8, 'lanczos')}, k AS (SELECT a.id, a.y, a.x, b.v > a.v AS up FROM sm a JOIN sm b ON a.id = b.id AND a.y = b.y AND b.x = a.x + 1) {_bits('up', 'dhash')}")
def resampled_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash(spark, sf_dir, "dhash")


@query(f"""WITH {_GRAY}, {_resized('gray', 'sm', 32, 32, 'lanczos')}, co AS (SELECT u, m, 2 * cos(pi() * u * (2 * m + 1) / 64) AS c FROM range(8) AS a(u), range(32) AS b(m)),
rw AS (SELECT id, u, x, sum(c * v) AS s FROM sm JOIN co ON y = m GROUP BY id, u, x), lo AS (SELECT id, rw.u AS y, co.u AS x, sum(c * s) AS s FROM rw JOIN co ON x = m GROUP BY id, rw.u, co.u),
k AS (SELECT *, median(s) OVER (PARTITION BY id) AS mid FROM lo) {_bits('s > mid', 'phash')}""")
def resampled_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash(spark, sf_dir, "phash")


_POWER = 1 << int(math.log2(min(WIDTH, HEIGHT)))


@query(f"""WITH {_GRAY}, {_resized('gray', 'sm', _POWER, _POWER, 'lanczos')}, lo AS (SELECT id, y // {_POWER // 8} AS y, x // {_POWER // 8} AS x, avg(v) AS s FROM sm GROUP BY ALL),
k AS (SELECT *, median(s) OVER (PARTITION BY id) AS mid FROM lo) {_bits('s > mid', 'whash')}""")
def resampled_whash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash(spark, sf_dir, "whash")


_SHARES = ["avg(CAST(black AS INTEGER))", "avg(CAST(pale AS INTEGER))"] + [f"count(*) FILTER (WHERE colored AND sat {op} 170 AND bin = {k}) / greatest(1, count(*) FILTER (WHERE colored))" for op in "<>" for k in range(6)]


@query(f"""WITH {_PX}, hv AS (SELECT id, {_TO_GRAY} AS l, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
t AS (SELECT *, CASE WHEN r = hi THEN (hi - b) / (hi - lo)::DOUBLE - (hi - g) / (hi - lo)::DOUBLE WHEN g = hi THEN 2 + (hi - r) / (hi - lo)::DOUBLE - (hi - b) / (hi - lo)::DOUBLE ELSE 4 + (hi - g) / (hi - lo)::DOUBLE - (hi - r) / (hi - lo)::DOUBLE END AS turn FROM hv),
h AS (SELECT id, l < 32 AS black, CASE WHEN hi > lo THEN floor(((turn / 6 + 1) % 1.0::DOUBLE) * 255) ELSE 0 END AS hue, CASE WHEN hi > lo THEN floor((hi - lo) / hi::DOUBLE * 255) ELSE 0 END AS sat FROM t),
c AS (SELECT id, black, NOT black AND sat < 85 AS pale, NOT black AND sat >= 85 AS colored, sat, least(5, floor(hue / 42.5)) AS bin FROM h)
SELECT id AS image_id, {" || ".join(f"printf('%02x', CAST(least(255, floor({s} * 256)) AS BIGINT))" for s in _SHARES)} AS chash FROM c GROUP BY id""")
def color_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.compute(color_rasters(spark, sf_dir), hashes=[("chash", 8)]).select("image_id", F.col("chash_8").alias("chash"))
