"""An audit of one image dataset: find issues, report, pick images to look at, save and load."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from os.path import commonprefix
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import duplicates, properties, registry, summary
from ..operators.quantiles import exact_quantiles
from ..operators.storage import remove, stored
from ..schema import COLUMNS, DEFAULTS, DUPLICATE_TYPES, PROPERTY, VERSION, flag_column, merged_params, score_column
from ..sources import build

#: Titles are set in letters of 7 points.
_LETTERS_PER_INCH = 72 / 7


@dataclass
class ReportConfig:
    max_prevalence: float = 0.5
    num_images: int = 4
    verbosity: int = 1


class ImageAudit:
    """``issues`` (a row for each image), ``issue_summary`` and ``info`` grow with every ``find_issues``."""

    def __init__(self, spark: SparkSession, data_path: str | None = None, filepaths: Sequence[str] | None = None, frame: DataFrame | None = None, image_key: str | None = None, id_column: str | None = None, storage_options: dict[str, str] | None = None, verbose: bool = True):
        self.spark, self.verbose, self.config = spark, verbose, ReportConfig()
        self._start(build(spark, data_path, filepaths, frame, image_key, id_column, storage_options))
        if self.images.isEmpty():
            raise ValueError("the source holds no image")

    def _start(self, images: DataFrame | None) -> None:
        self.images = images
        self.version = VERSION
        self._properties: DataFrame | None = None  # written; all that was computed so far
        self._have: set[str] = set()
        self._written: list[str] = []
        self._params: dict[str, dict[str, Any]] = {}
        self._custom: dict[str, DataFrame] = {}
        self._hashes: dict[str, str] = {}
        self.issues: DataFrame | None = None
        self.issue_summary: DataFrame | None = None
        self.info: dict[str, Any] = {"statistics": {}}
        self._types: list[str] = []

    @classmethod
    def of_properties(cls, spark: SparkSession, found: DataFrame, images: DataFrame | None = None) -> ImageAudit:
        """An audit over properties and hashes that were computed before, such as those a stream has stored."""
        self = cls.__new__(cls)
        self.spark, self.verbose, self.config = spark, True, ReportConfig()
        self._start(images)
        self._properties = found
        self._have = {p for p, columns in COLUMNS.items() if set(columns) <= set(found.columns)}
        self._have |= set(found.columns) - {c for columns in COLUMNS.values() for c in columns}
        return self

    # Issue types

    @staticmethod
    def list_default_issue_types() -> list[str]:
        return list(DEFAULTS)

    @staticmethod
    def list_possible_issue_types() -> list[str]:
        return [*DEFAULTS, *(n for n in registry.registered() if n not in DEFAULTS)]

    # Finding

    def _stored(self, df: DataFrame) -> DataFrame:
        """Write ``df`` where all executors can read it: a recomputed part would decode images again."""
        return stored(df, self._written)

    def close(self) -> None:
        """Remove the tables of this audit; what was not saved is lost."""
        remove(self.spark, self._written)

    def _compute(self, wanted: list[str], hashes: list[tuple[str, int | None]], kernels: dict[str, registry.PixelDetector] | None = None) -> None:
        names = {properties.hash_column(k, n): (k, n) for k, n in hashes}
        props = [p for p in wanted if p not in self._have]
        new = [v for k, v in names.items() if k not in self._have]
        own = {registry.value_column(t): d.kernel for t, d in (kernels or {}).items() if registry.value_column(t) not in self._have}
        if not props and not new and not own and self._properties is not None:
            return
        if self.images is None:
            raise ValueError("this needs the images, which were not given")
        got = properties.compute(self.images, props, new, own)
        if self._properties is None:
            self._properties = self._stored(got)
        else:
            self._properties = self._stored(self._properties.join(got.drop("ord", "name"), "image_id"))
        self._have |= set(props) | set(names) | set(own)

    def find_issues(self, issue_types: dict[str, dict[str, Any]] | None = None, n_jobs: int | None = None, verbose: bool | None = None) -> None:
        """Find the given types, with parameters by type; all default ones if none are given.

        Properties that an earlier call computed are scored again, not computed again.
        ``n_jobs`` changes nothing: Spark deals out the work.
        """
        request = dict(issue_types) if issue_types else {t: {} for t in DEFAULTS}
        for t in request:
            if t not in DEFAULTS:
                registry.detector(t)  # raises if unknown
        params = {t: merged_params(t, p) if t in DEFAULTS else registry.detector(t).params(p) for t, p in request.items()}
        hashes = {t: (params[t]["hash_type"], None if params[t]["hash_type"] == "md5" else params[t]["hash_size"] if "hash_size" in params[t] else 8) for t in DUPLICATE_TYPES if t in request}
        if "near_duplicates" in request and "exact_duplicates" not in hashes and "exact_duplicates" not in self._hashes:
            hashes["exact_duplicates"] = ("md5", None)
        custom = {t: registry.detector(t) for t in request if t not in DEFAULTS}
        self._compute(list(dict.fromkeys(PROPERTY[t] for t in request if t in PROPERTY)), list(hashes.values()), {t: d for t, d in custom.items() if isinstance(d, registry.PixelDetector)})
        self._hashes |= {t: properties.hash_column(k, n) for t, (k, n) in hashes.items()}
        for t, d in custom.items():
            found = d.scored(self._properties, t, params[t]) if isinstance(d, registry.PixelDetector) else d.transform(self.images, params[t])
            self._custom[t] = self._stored(found)
        self._params |= params
        self._types += [t for t in request if t not in self._types]
        self._assemble()
        fresh = summary.counts(self.issues, list(request))
        table = fresh if self.issue_summary is None else summary.upserted(self.issue_summary, fresh)
        rows = [(r["issue_type"], r["num_images"]) for r in summary.ordered(table).collect()]  # a row for each type
        self.issue_summary = self.spark.createDataFrame(rows, "issue_type string, num_images long").coalesce(1)
        self._inform(list(request))
        if self.verbose if verbose is None else verbose:
            print(f"{sum(n for _, n in rows)} flags over {len(rows)} issue types; report() lists the worst images.")

    def _assemble(self) -> None:
        """``issues`` as one plan over the stored properties."""
        df = self._properties
        if "odd_size" in self._types:
            fences = exact_quantiles(df, "size", (0.25, 0.75)).select(*scores.size_fences(F.col("q"), self._params["odd_size"]["iqr_factor"]))
            df = df.crossJoin(F.broadcast(fences))  # one row
        out: list = []
        for t in self._types:
            if t in scores.SCORES or t == "odd_size":
                p = self._params[t]
                score = scores.size_score(F.col("size")) if t == "odd_size" else scores.SCORES[t](p)
                limit = scores.size_threshold(p["threshold"]) if t == "odd_size" else F.lit(0.5) if t == "grayscale" else F.lit(p["threshold"])
                out += [score.alias(score_column(t)), scores.flag(score, limit).alias(flag_column(t))]
        keys = [F.col(c) for c in dict.fromkeys(["image_id", "ord", "name", *(self._hashes[t] for t in DUPLICATE_TYPES if t in self._hashes)])]
        frame = df.select(*keys, *out)
        for t in DUPLICATE_TYPES:
            if t in self._types:
                frame = duplicates.flagged(frame, self.duplicate_sets(t), self._hashes[t], t)
        for t in self._types:
            if t in self._custom:
                frame = frame.join(self._custom[t].select("image_id", score_column(t), flag_column(t)), "image_id", "left").fillna({flag_column(t): False})
        columns = [c for t in self._types for c in (score_column(t), flag_column(t))]
        self.issues = self._stored(frame.select("image_id", "ord", "name", *columns))

    def duplicate_sets(self, issue: str) -> DataFrame:
        """hash, set_size, first_ord; near sets that are whole exact sets are left out."""
        if issue == "exact_duplicates":
            return duplicates.set_sizes(self._properties, self._hashes[issue])
        return duplicates.near_only(self._properties, self._hashes[issue], self._hashes["exact_duplicates"])

    def _inform(self, types: list[str]) -> None:
        new: dict[str, Any] = {"statistics": {}}
        for t in types:
            if t in PROPERTY:
                p = PROPERTY[t]
                new[t] = self._properties.select("image_id", *COLUMNS[p])
                new["statistics"][p] = summary.describe_category(self._properties, p) if p == "color_space" else summary.describe(self._properties, p)
            elif t in self._custom:
                new[t] = self._custom[t]
        for t in DUPLICATE_TYPES:
            if t in self._hashes and (t in types or "near_duplicates" in types):
                sets = self.duplicate_sets(t)
                rows = duplicates.members(self._properties, sets, self._hashes[t])
                new[t] = {"members": rows, "sets": duplicates.as_lists(rows), "num_sets": sets.count()}
        self.info = summary.deep_merged(self.info, new)

    # Reading

    def get_stats(self) -> dict[str, DataFrame]:
        """Statistics of each property that was computed."""
        return self.info["statistics"]

    def report(self, issue_types: Sequence[str] | None = None, max_prevalence: float | None = None, num_images: int | None = None, verbosity: int | None = None, print_summary: bool = True, show_id: bool = False) -> DataFrame:
        """Print the summary and return the most severe images of each type that is not too common."""
        most = self.config.max_prevalence if max_prevalence is None else max_prevalence
        k = self.config.num_images if num_images is None else num_images
        verbosity = self.config.verbosity if verbosity is None else verbosity
        if not 0 <= verbosity < 5:
            raise ValueError("verbosity must be from 0 to 4")
        total = self.issues.count()
        table = self.issue_summary if issue_types is None else self.issue_summary.where(F.col("issue_type").isin(list(issue_types)))
        kept = {r["issue_type"] for r in summary.prevalent(table, total, most).collect()}
        rows = [r.asDict() for r in summary.ordered(table).collect()]
        gone = [r["issue_type"] for r in rows if r["issue_type"] not in kept]
        if gone and verbosity:
            print(f"Left out, since a share of {most} or more of all images has them: {', '.join(gone)}")
        rows = [r for r in rows if r["issue_type"] in kept]
        if not rows:
            print("Nothing to report: run find_issues() with at least one issue type first.")
        elif print_summary and verbosity:
            print("Flagged images by issue type, most frequent first\n\n" + markdown(rows))
        shown = [r["issue_type"] for r in rows if r["num_images"]]
        for r in rows:
            if r["num_images"] and verbosity:
                print(f"== {r['issue_type']}: {r['num_images']} flagged; the worst are shown")
        return self.visualize(issue_types=shown, num_images=k, show_id=show_id) if shown else self._empty_view()

    def _empty_view(self) -> DataFrame:
        return self.images.select(F.lit("").alias("issue_type"), F.lit(0).alias("rank"), "image_id", F.lit(0.0).alias("score"), F.lit("").alias("title"), "image").limit(0)

    def visualize(self, image_files: Sequence[str] | None = None, indices: Sequence[Any] | None = None, issue_types: Sequence[str] | None = None, num_images: int = 4, cell_size: tuple[float, float] = (2, 2), show_id: bool = False, seed: int | None = None) -> DataFrame:
        """Images to look at: issue_type, rank, image_id, score, title, image.

        By issue type (the worst, or of duplicates the largest sets), else by path,
        else by id, else at random.  Only the chosen images are read.
        """
        sets: list[DataFrame] = []
        if issue_types is not None:
            if not list(issue_types):
                raise ValueError("issue_types list is empty")
            single = [t for t in issue_types if t not in DUPLICATE_TYPES]
            picks: list[tuple] = []
            if single:
                picks += [(r["issue_type"], r["rank"], r["image_id"], r["score"], None) for r in summary.worst_of_each(self.issues, single, num_images).collect()]
            sets = [self._largest_sets(t, num_images, cell_size[0]) for t in issue_types if t in DUPLICATE_TYPES]
        elif image_files is not None:
            if not list(image_files):
                raise ValueError("image_files list is empty")
            found = build(self.spark, filepaths=list(image_files))
            return found.select(F.lit("").alias("issue_type"), (F.col("ord") + 1).cast("int").alias("rank"), "image_id", F.lit(None).cast("double").alias("score"), F.col("name").alias("title"), "image")
        elif indices is not None:
            picks = [("", n + 1, i, None, None) for n, i in enumerate(indices)]
        else:
            some = self.images.select("image_id").orderBy(F.rand(seed)).limit(num_images).collect()
            picks = [("", n + 1, r["image_id"], None, None) for n, r in enumerate(some)]
        if not picks and not sets:
            return self._empty_view()
        kind = self.images.schema["image_id"].dataType.simpleString()
        chosen = self.spark.createDataFrame(picks, f"issue_type string, rank int, image_id {kind}, score double, note string")
        rows = self.images.join(reduce(DataFrame.unionByName, sets, chosen), "image_id")
        size = F.when(F.col("issue_type") == "odd_size", F.concat(F.lit("size: ("), F.col("image.width"), F.lit(", "), F.col("image.height"), F.lit(")")))
        score = F.when(F.col("note").isNull() & F.col("score").isNotNull(), F.format_string("score : %.4f", "score"))
        name = F.coalesce("note", F.when(F.col("score").isNull(), F.col("name")))
        title = F.concat_ws("\n", name, score, F.when(F.lit(show_id), F.concat(F.lit("id : "), F.col("image_id").cast("string"))), size)
        return rows.select("issue_type", "rank", "image_id", "score", title.alias("title"), "image").orderBy("issue_type", "rank")

    def _largest_sets(self, issue: str, k: int, cell_width: float) -> DataFrame:
        """issue_type, rank, image_id, score, note of all members of the ``k`` largest sets; nothing is collected."""
        top = self.duplicate_sets(issue).orderBy(F.desc("set_size"), "first_ord").limit(k)
        rows = duplicates.members(self._properties, top, self._hashes[issue]).join(self._properties.select("image_id", "name"), "image_id")
        ends = rows.groupBy("set_id").agg(*titles_in_common("name", cell_width))
        place = F.row_number().over(Window.partitionBy("set_id").orderBy("ord"))
        sizes = rows.select("set_id", "set_size").distinct()
        first = F.sum("set_size").over(Window.orderBy(F.desc("set_size"), "set_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("set_size")  # k rows
        starts = sizes.withColumn("start", first).drop("set_size")
        ranked = rows.withColumn("place", place).join(F.broadcast(starts), "set_id").join(F.broadcast(ends), "set_id")
        return ranked.select(F.lit(issue).alias("issue_type"), (F.col("start") + F.col("place")).cast("int").alias("rank"), "image_id", (1.0 / F.col("set_size")).alias("score"), fitted_title("name", cell_width).alias("note"))

    # Persistence

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, path: str, force: bool = False) -> None:
        """Write issues, summary and properties as Parquet and the rest as JSON; images are not copied."""
        fs, p = self._fs(path)
        if fs.exists(p) and not force:
            raise FileExistsError(f"{path} exists; use force=True to overwrite it")
        mode = "overwrite" if force else "errorifexists"
        self.issues.write.mode(mode).parquet(f"{path}/issues")
        self.issue_summary.write.mode(mode).parquet(f"{path}/issue_summary")
        self._properties.write.mode(mode).parquet(f"{path}/properties")
        for t, df in self._custom.items():
            df.write.mode(mode).parquet(f"{path}/custom_{t}")
        state = {"version": self.version, "types": self._types, "params": self._params, "hashes": self._hashes, "have": sorted(self._have), "custom": sorted(self._custom)}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, data_path: str | None = None, frame: DataFrame | None = None, image_key: str | None = None) -> ImageAudit:
        """A saved audit. With its images given again it can find more issues."""
        self = cls.__new__(cls)
        self.spark, self.verbose, self.config = spark, True, ReportConfig()
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise ValueError(f"{path} does not exist")
        self._start(build(spark, data_path, None, frame, image_key) if data_path or frame is not None else None)
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        if state["version"] != VERSION:
            warnings.warn(f"saved by version {state['version']}, loaded by {VERSION}", stacklevel=2)
        self._types, self._params, self._hashes, self._have = state["types"], state["params"], state["hashes"], set(state["have"])
        self._properties = spark.read.parquet(f"{path}/properties")
        self.issues, self.issue_summary = spark.read.parquet(f"{path}/issues"), spark.read.parquet(f"{path}/issue_summary")
        self._custom = {t: spark.read.parquet(f"{path}/custom_{t}") for t in state["custom"]}
        self._inform(self._types)
        return self


def markdown(rows: list[dict[str, Any]]) -> str:
    """A table; columns without any value are left out, other gaps are N/A."""
    if not rows:
        return ""
    names = [c for c in rows[0] if any(r[c] is not None and not (isinstance(r[c], float) and math.isnan(r[c])) for r in rows)]
    body = [["" if r is None else str(r) for r in ([i, *(row[c] if row[c] is not None else "N/A" for c in names)])] for i, row in enumerate(rows)]
    head = ["", *names]
    width = [max(len(head[k]), *(len(b[k]) for b in body)) for k in range(len(head))]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, body)])


def truncated(titles: Sequence[str], cell_width: float = 2.0) -> list[str]:
    """Titles that fit a cell of ``cell_width`` inches; of what all share, the longer end is cut."""
    room = math.ceil(cell_width * _LETTERS_PER_INCH) - 4
    heads, tails = [t[:room] for t in titles], [t[::-1][:room] for t in titles]
    from_front = len(commonprefix(heads)) > len(commonprefix(tails))
    short = lambda t: "..." + t[-room:] if from_front else t[:room] + "..."
    return [t if len(t) < cell_width * _LETTERS_PER_INCH else short(t) for t in titles]


def _room(cell_width: float) -> int:
    return math.ceil(cell_width * _LETTERS_PER_INCH) - 4


def _shared(a: Column, b: Column, room: int) -> Column:
    """How many letters two strings share at their start, ``room`` at most."""
    same = lambda k: (F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.length(a) >= k) & (F.length(b) >= k)
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(room)), same))


def titles_in_common(name: str, cell_width: float) -> list[Column]:
    """Aggregate for ``fitted_title``: is the shared start longer than the shared end?

    What all strings share at their start is what the least and the greatest share.
    """
    room = _room(cell_width)
    head, tail = F.substring(name, 1, room), F.substring(F.reverse(name), 1, room)
    return [(_shared(F.min(head), F.max(head), room) > _shared(F.min(tail), F.max(tail), room)).alias("from_front")]


def fitted_title(name: str, cell_width: float) -> Column:
    """``truncated`` as an expression over ``from_front``."""
    room = _room(cell_width)
    short = F.when(F.col("from_front"), F.concat(F.lit("..."), F.substring(name, -room, room))).otherwise(F.concat(F.substring(name, 1, room), F.lit("...")))
    return F.when(F.length(name) < cell_width * _LETTERS_PER_INCH, F.col(name)).otherwise(short)
