"""Queries that run the audit's operators on tables, each with SQL for the same rows.

The tables hold no images.  Vectors of 64 values serve as images of 8 x 8 gray
pixels (or 7 x 3 colored ones), and documents, parts and pages as rows that have a
size, a category, a shape or a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import duplicates, properties, summary
from ..operators.quantiles import exact_quantiles
from ..operators.storage import stored
from ..schema import DEFAULTS, flag_column, score_column

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Rasters from vectors


def _pixels() -> Column:
    return F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))


def rasters(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """Images of 8 x 8 gray pixels, or of 7 x 3 pixels of three channels."""
    n, (h, w) = (64, (8, 8)) if channels == 1 else (63, (3, 7))
    data = F.unhex(F.concat_ws("", F.transform(F.slice(_pixels(), 1, n), lambda p: F.lpad(F.hex(p), 2, "0"))))
    image = F.struct(F.lit("").alias("origin"), F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(channels).alias("nChannels"), F.lit(0 if channels == 1 else 16).alias("mode"), data.alias("data"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("ord"), F.lit("").alias("name"), image.alias("image"))


_PX = """px AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i,
  greatest(0, least(255, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5) AS INTEGER))) AS v FROM embeddings)"""


@query(f"""WITH {_PX}
SELECT vec_id AS image_id, round(quantile_cont(v / 255.0, 0.99), 6) AS dark_score, quantile_cont(v / 255.0, 0.99) < 0.32 AS is_dark_issue,
  round(1 - quantile_cont(v / 255.0, 0.05), 6) AS light_score, 1 - quantile_cont(v / 255.0, 0.05) < 0.05 AS is_light_issue
FROM px GROUP BY vec_id""")
def dark_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = properties.compute(rasters(spark, sf_dir), ["brightness"])
    out = [df["image_id"]]
    for t in ("dark", "light"):
        out += [F.round(scores.SCORES[t](DEFAULTS[t]), 6).alias(score_column(t)), scores.flag(scores.SCORES[t](DEFAULTS[t]), DEFAULTS[t]["threshold"]).alias(flag_column(t))]
    return df.select(*out)


_PERC = ", ".join(f"round(quantile_cont(v / 255.0, {p / 100}), 6) AS brightness_perc_{p}" for p in (1, 5, 10, 15, 90, 95, 99))


@query(f"""WITH {_PX} SELECT vec_id AS image_id, {_PERC}, round(sqrt((0.241 + 0.691 + 0.068) * avg(v) * avg(v)) / 255, 6) AS brightness FROM px GROUP BY vec_id""")
def brightness_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = properties.compute(rasters(spark, sf_dir), ["brightness"]).drop("ord", "name")
    return _rounded(df, *df.columns[1:])


@query(f"""WITH {_PX}, c AS (SELECT vec_id, avg(v) FILTER (WHERE i % 3 = 2) AS r, avg(v) FILTER (WHERE i % 3 = 1) AS g, avg(v) FILTER (WHERE i % 3 = 0) AS b FROM px WHERE i < 63 GROUP BY vec_id)
SELECT vec_id AS image_id, round(sqrt(0.241 * r * r + 0.691 * g * g + 0.068 * b * b) / 255, 6) AS brightness FROM c""")
def average_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(properties.compute(rasters(spark, sf_dir, 3), ["brightness"]).select("image_id", "brightness"), "brightness")


@query(f"""WITH {_PX}, n AS (SELECT vec_id, v, count(*) AS c FROM px GROUP BY vec_id, v)
SELECT vec_id AS image_id, round(-sum(c / 64.0 * log2(c / 64.0)) + 0.0, 6) AS entropy, round(least(1.0, 0.1 * -sum(c / 64.0 * log2(c / 64.0))), 6) AS low_information_score,
  least(1.0, 0.1 * -sum(c / 64.0 * log2(c / 64.0))) < 0.3 AS is_low_information_issue FROM n GROUP BY vec_id""")
def raster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = properties.compute(rasters(spark, sf_dir), ["entropy"])
    p = DEFAULTS["low_information"]
    return _rounded(df.select("image_id", "entropy", scores.entropy_score(p).alias("low_information_score"), scores.flag(scores.entropy_score(p), p["threshold"]).alias("is_low_information_issue")), "entropy", "low_information_score")


@query(f"""WITH {_PX},
e AS (SELECT p.vec_id, p.i, CASE WHEN p.i // 8 IN (0, 7) OR p.i % 8 IN (0, 7) THEN any_value(p.v) ELSE greatest(0, least(255, 9 * any_value(p.v) - sum(q.v))) END AS e
  FROM px p JOIN px q ON p.vec_id = q.vec_id AND abs(p.i // 8 - q.i // 8) <= 1 AND abs(p.i % 8 - q.i % 8) <= 1 GROUP BY p.vec_id, p.i),
b AS (SELECT vec_id, sqrt(var_pop(e)) AS blurriness FROM e GROUP BY vec_id),
h AS (SELECT vec_id, sum(c * c) AS s2 FROM (SELECT vec_id, v, count(*) AS c FROM px GROUP BY vec_id, v) AS n GROUP BY vec_id),
s AS (SELECT b.vec_id, blurriness, sqrt(s2 / 256.0 - 0.0625) AS spread FROM b JOIN h ON b.vec_id = h.vec_id),
f AS (SELECT vec_id, blurriness, spread, least(1.0, 1 - exp(-0.01 * blurriness) + CASE WHEN 1 - exp(-0.01 * spread) <= 0.18 THEN 0 ELSE 1 - exp(-0.01 * spread) END) AS score FROM s)
SELECT vec_id AS image_id, round(blurriness, 6) AS blurriness, round(spread, 6) AS blurriness_grayscale_std, round(score, 6) AS blurry_score, score < 0.29 AS is_blurry_issue FROM f""")
def blurry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = DEFAULTS["blurry"]
    df = properties.compute(rasters(spark, sf_dir), ["blurriness"]).withColumns({"blurry_score": scores.blur_score(p), "is_blurry_issue": scores.flag(scores.blur_score(p), p["threshold"])})
    return _rounded(df.drop("ord", "name"), "blurriness", "blurriness_grayscale_std", "blurry_score")


@query(f"""WITH {_PX}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY vec_id)
SELECT px.vec_id AS image_id, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY i) AS ahash FROM px JOIN m ON px.vec_id = m.vec_id GROUP BY px.vec_id""")
def average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = properties.compute(rasters(spark, sf_dir), hashes=[("ahash", 8)])
    return df.select("image_id", F.lpad(F.conv("ahash_8", 16, 2), 64, "0").alias("ahash"))


@query("""SELECT vec_id AS image_id, 1.0::DOUBLE AS aspect_ratio, 'L' AS color_space, 8.0::DOUBLE AS size, 0.0::DOUBLE AS grayscale_score, true AS is_grayscale_issue FROM embeddings""")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = properties.compute(rasters(spark, sf_dir), ["aspect_ratio", "color_space", "size"])
    score = scores.grayscale_score()
    return df.select("image_id", "aspect_ratio", "color_space", F.round("size", 6).alias("size"), score.alias("grayscale_score"), scores.flag(score, 0.5).alias("is_grayscale_issue"))


# Rows of tables as images

#: Statistics of a whole text that texts much alike share: a coarse hash for near duplicates.
_NEAR_SQL = "lang || ':' || CAST(n_chars // 16 AS VARCHAR) || ':' || CAST(length(regexp_replace(text, '[^a-m]', '', 'g')) // 16 AS VARCHAR)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x: F.floor(x / 16).cast("long").cast("string")
    near = F.concat_ws(":", "lang", part(F.col("n_chars")), part(F.length("text") - F.length(F.translate("text", "abcdefghijklm", ""))))
    size = scores.size(F.col("n_chars"), F.lit(1))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("ord"), F.md5("text").alias("exact"), near.alias("near"), size.alias("size"), F.col("lang").alias("color_space"))


_EXACT = "d AS (SELECT doc_id, md5(text) AS exact FROM documents), s AS (SELECT exact, count(*) AS n, min(doc_id) AS first_ord FROM d GROUP BY exact HAVING count(*) > 1)"


@query(f"""WITH {_EXACT} SELECT d.doc_id AS image_id, CASE WHEN n > 1 THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END AS exact_duplicates_score, coalesce(n > 1, false) AS is_exact_duplicates_issue FROM d LEFT JOIN s ON d.exact = s.exact""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("image_id", "ord", "exact")
    return duplicates.flagged(df, duplicates.set_sizes(df, "exact"), "exact", "exact_duplicates").drop("ord", "exact")


@query(f"WITH {_EXACT} SELECT s.first_ord AS set_id, d.doc_id AS image_id, n AS set_size FROM d JOIN s ON d.exact = s.exact")
def exact_duplicate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("image_id", "ord", "exact")
    return duplicates.members(df, duplicates.set_sizes(df, "exact"), "exact").drop("ord")


_NEAR = f"""d AS (SELECT doc_id, md5(text) AS exact, {_NEAR_SQL} AS near FROM documents), x AS (SELECT exact, count(*) AS ne FROM d GROUP BY exact),
g AS (SELECT near, count(*) AS n, min(doc_id) AS first_ord, min(exact) AS lo, max(exact) AS hi FROM d GROUP BY near HAVING count(*) > 1),
s AS (SELECT near, n, first_ord FROM g JOIN x ON g.lo = x.exact WHERE NOT (lo = hi AND n = ne))"""


@query(f"""WITH {_NEAR} SELECT d.doc_id AS image_id, CASE WHEN n > 1 THEN 1.0::DOUBLE / n ELSE 1.0::DOUBLE END AS near_duplicates_score, coalesce(n > 1, false) AS is_near_duplicates_issue FROM d LEFT JOIN s ON d.near = s.near""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("image_id", "ord", "exact", "near")
    return duplicates.flagged(df, duplicates.near_only(df, "near", "exact"), "near", "near_duplicates").drop("ord", "exact", "near")


@query(f"WITH {_NEAR} SELECT first_ord AS set_id, n AS set_size FROM s")
def near_duplicate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("image_id", "ord", "exact", "near")
    return duplicates.near_only(df, "near", "exact").select(F.col("first_ord").alias("set_id"), "set_size")


_SIZE = """z AS (SELECT doc_id, sqrt(n_chars) AS size FROM documents), q AS (SELECT quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3 FROM z),
m AS (SELECT (q1 + q3) / 2 AS mid, (q3 - q1) * 7.0 AS gap FROM q),
o AS (SELECT doc_id, 1 - least(1.0, abs(size - mid) / CASE WHEN gap > 0 THEN gap ELSE mid END) AS score, CASE WHEN gap > 0 THEN 0.5 ELSE 1.0 END AS lim FROM z, m)"""


def _odd_size(df: DataFrame) -> DataFrame:
    fences = exact_quantiles(df, "size", (0.25, 0.75)).select(*scores.size_fences(F.col("q"), DEFAULTS["odd_size"]["iqr_factor"]))
    fenced = df.crossJoin(F.broadcast(fences))  # one row
    score = scores.size_score(F.col("size"))
    return fenced.withColumns({"odd_size_score": score, "is_odd_size_issue": scores.flag(score, scores.size_threshold(None))}).drop("size_middle", "size_gap")


@query(f"WITH {_SIZE} SELECT doc_id AS image_id, round(score, 6) AS odd_size_score, score < lim AS is_odd_size_issue FROM o")
def odd_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_odd_size(_documents(spark, sf_dir)).select("image_id", "odd_size_score", "is_odd_size_issue"), "odd_size_score")


@query("""SELECT p_partkey AS image_id, round(least(p_size / 25.0, 25.0 / p_size), 6) AS odd_aspect_ratio_score, least(p_size / 25.0, 25.0 / p_size) < 0.35 AS is_odd_aspect_ratio_issue FROM part""")
def odd_aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), scores.aspect_ratio(F.col("p_size"), F.lit(25)).alias("aspect_ratio"))
    return _rounded(df.select("image_id", scores.aspect_score().alias("odd_aspect_ratio_score"), scores.flag(scores.aspect_score(), DEFAULTS["odd_aspect_ratio"]["threshold"]).alias("is_odd_aspect_ratio_issue")), "odd_aspect_ratio_score")


def _text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy over the characters of each text, counted where the text is: no row for a character, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] if text else np.ones(1)
                out.append(float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()))
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], names=["image_id", "entropy"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text")
    return docs.where("text is not null").mapInArrow(run, f"image_id {docs.schema['image_id'].dataType.simpleString()}, entropy double")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY doc_id, c),
t AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM n GROUP BY doc_id)
SELECT doc_id AS image_id, round(e, 6) AS entropy, round(least(1.0, 0.1 * e), 6) AS low_information_score, least(1.0, 0.1 * e) < 0.3 AS is_low_information_issue FROM t""")
def low_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = DEFAULTS["low_information"]
    df = _text_entropy(spark, sf_dir).withColumns({"low_information_score": scores.entropy_score(p), "is_low_information_issue": scores.flag(scores.entropy_score(p), p["threshold"])})
    return _rounded(df, "entropy", "low_information_score")


@query("""SELECT doc_id AS image_id, CASE WHEN lang = 'en' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS grayscale_score, lang = 'en' AS is_grayscale_issue FROM documents""")
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).withColumn("color_space", F.when(F.col("color_space") == "en", "L").otherwise(F.col("color_space")))
    return df.select("image_id", scores.grayscale_score().alias("grayscale_score"), scores.flag(scores.grayscale_score(), 0.5).alias("is_grayscale_issue"))


_TYPES = ("exact_duplicates", "near_duplicates", "odd_size", "grayscale")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _odd_size(stored(_documents(spark, sf_dir))).withColumn("color_space", F.when(F.col("color_space") == "en", "L").otherwise(F.col("color_space")))
    df = df.withColumns({"grayscale_score": scores.grayscale_score(), "is_grayscale_issue": scores.flag(scores.grayscale_score(), 0.5)})
    df = duplicates.flagged(df, duplicates.near_only(df, "near", "exact"), "near", "near_duplicates")
    return duplicates.flagged(df, duplicates.set_sizes(df, "exact"), "exact", "exact_duplicates")


_ALL = f"""{_NEAR}, {_SIZE}, e AS (SELECT exact, count(*) AS n FROM d GROUP BY exact HAVING count(*) > 1),
i AS (SELECT d.doc_id, coalesce(e.n > 1, false) AS ex, coalesce(1.0::DOUBLE / e.n, 1.0) AS exs, coalesce(s.n > 1, false) AS ne, coalesce(1.0::DOUBLE / s.n, 1.0) AS nes, o.score < o.lim AS od, o.score AS ods, c.lang = 'en' AS gr, CASE WHEN c.lang = 'en' THEN 0.0 ELSE 1.0 END AS grs
  FROM d LEFT JOIN e ON d.exact = e.exact LEFT JOIN s ON d.near = s.near JOIN o ON d.doc_id = o.doc_id JOIN documents c ON d.doc_id = c.doc_id),
t AS (SELECT 'exact_duplicates' AS issue_type, count(*) FILTER (WHERE ex) AS num_images FROM i UNION ALL SELECT 'near_duplicates', count(*) FILTER (WHERE ne) FROM i
  UNION ALL SELECT 'odd_size', count(*) FILTER (WHERE od) FROM i UNION ALL SELECT 'grayscale', count(*) FILTER (WHERE gr) FROM i)"""


@query(f"WITH {_ALL} SELECT issue_type, num_images FROM t")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ordered(summary.counts(_issues(spark, sf_dir), _TYPES))


@query(f"WITH {_ALL} SELECT issue_type, num_images FROM t WHERE num_images / (SELECT count(*)::DOUBLE FROM documents) < 0.5")
def prevalence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.prevalent(summary.counts(_issues(spark, sf_dir), _TYPES), table(spark, sf_dir, "documents").count(), 0.5)


@query(f"""WITH {_ALL}, l AS (SELECT doc_id, 'exact_duplicates' AS issue_type, exs AS score FROM i WHERE ex UNION ALL SELECT doc_id, 'near_duplicates', nes FROM i WHERE ne UNION ALL SELECT doc_id, 'odd_size', ods FROM i WHERE od UNION ALL SELECT doc_id, 'grayscale', grs FROM i WHERE gr),
r AS (SELECT issue_type, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY issue_type ORDER BY round(score, 12), doc_id) AS rank FROM l)
SELECT issue_type, doc_id AS image_id, score, rank FROM r WHERE rank <= 4""")
def worst_of_each_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    issues = issues.withColumns({score_column(t): F.round(score_column(t), 12) for t in _TYPES})
    out = summary.worst_of_each(issues, _TYPES, 4).drop("ord")
    return _rounded(out, "score")


@query(f"WITH {_ALL} SELECT doc_id AS image_id, round(ods, 6) AS odd_size_score FROM i WHERE od ORDER BY round(ods, 12), doc_id LIMIT 10")
def worst_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _odd_size(_documents(spark, sf_dir)).withColumn("odd_size_score", F.round("odd_size_score", 12))
    return _rounded(summary.worst(issues, "odd_size", 10).select("image_id", "odd_size_score"), "odd_size_score")


@query(f"WITH {_EXACT} SELECT first_ord AS set_id, n AS set_size FROM s ORDER BY n DESC, first_ord LIMIT 4")
def largest_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("image_id", "ord", "exact")
    return duplicates.set_sizes(df, "exact").orderBy(F.desc("set_size"), "first_ord").limit(4).select(F.col("first_ord").alias("set_id"), "set_size")


@query("""WITH z AS (SELECT sqrt(n_chars) AS x FROM documents), a AS (SELECT count(x)::DOUBLE AS c, avg(x) AS m, stddev_samp(x) AS s, min(x) AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS hi FROM z)
SELECT 'count' AS statistic, round(c, 6) AS value FROM a UNION ALL SELECT 'mean', round(m, 6) FROM a UNION ALL SELECT 'std', round(s, 6) FROM a UNION ALL SELECT 'min', round(lo, 6) FROM a
UNION ALL SELECT '25%', round(q1, 6) FROM a UNION ALL SELECT '50%', round(q2, 6) FROM a UNION ALL SELECT '75%', round(q3, 6) FROM a UNION ALL SELECT 'max', round(hi, 6) FROM a""")
def describe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.describe(_documents(spark, sf_dir), "size"), "value")


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT max(n) AS f FROM n)
SELECT 'count' AS statistic, CAST(sum(n) AS VARCHAR) AS value FROM n UNION ALL SELECT 'unique', CAST(count(*) AS VARCHAR) FROM n UNION ALL SELECT 'freq', CAST(f AS VARCHAR) FROM m UNION ALL SELECT 'top', max(lang) FROM n WHERE n = (SELECT f FROM m)""")
def describe_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.describe_category(_documents(spark, sf_dir), "color_space")


_OLD_NEW = """o AS (SELECT c_custkey AS image_id, c_acctbal AS score, c_mktsegment AS kept FROM customer), n AS (SELECT o_custkey AS image_id, max(o_totalprice) AS score, count(*) AS added FROM orders GROUP BY o_custkey)"""


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("kept"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("image_id")).agg(F.max("o_totalprice").alias("score"), F.count(F.lit(1)).alias("added"))
    return old, new


@query(f"WITH {_OLD_NEW} SELECT o.image_id, kept, n.score, added FROM o LEFT JOIN n ON o.image_id = n.image_id")
def merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.merged(*_old_new(spark, sf_dir))


@query(f"WITH {_OLD_NEW} SELECT o.image_id, kept, o.score, added FROM o LEFT JOIN n ON o.image_id = n.image_id")
def merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.merged(*_old_new(spark, sf_dir), overwrite=False)


@query("""WITH o AS (SELECT event_type AS issue_type, count(*) AS num_images FROM events GROUP BY event_type), n AS (SELECT event_type AS issue_type, count(*) AS num_images FROM events WHERE value > 50 GROUP BY event_type HAVING event_type < 'n')
SELECT o.issue_type, o.num_images FROM o WHERE o.issue_type NOT IN (SELECT issue_type FROM n) UNION ALL SELECT issue_type, num_images FROM n""")
def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "issue_type")
    count = F.count(F.lit(1)).alias("num_images")
    return summary.upserted(events.groupBy("issue_type").agg(count), events.where("value > 50 and issue_type < 'n'").groupBy("issue_type").agg(count))


@query("SELECT page_id AS image_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), F.element_at(F.split("url", "/"), -1).alias("name"))
