from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import png
from pyspark.sql import functions as F

from prismal import Detector, ImageAudit, PixelDetector, register_detector
from prismal.functions import scores
from prismal.operators import duplicates, registry, summary
from prismal.operators.quantiles import exact_quantiles
from prismal.plans.session import markdown, truncated
from prismal.schema import DEFAULTS, flag_column, merged_params, score_column
from prismal.sources import from_files, from_folder, list_files


def flags(audit, issue):
    return {r["name"] for r in audit.issues.where(flag_column(issue)).collect()}


def test_golden_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:100, 0:100]
    textured = lambda k: (rng.integers(0, 256, (100, 100, 3)) * 0.5 + 60 + k).clip(0, 255).astype(np.uint8)
    files = {f"plain_{k}.png": textured(k) for k in range(5)}
    files["dark.png"] = (textured(0) // 8).astype(np.uint8)
    files["light.png"] = (255 - rng.integers(0, 4, (100, 100, 3))).astype(np.uint8)
    files["wide.png"] = textured(1)[:20].repeat(1, axis=0)
    files["gray.png"] = textured(2)[:, :, 0]
    smooth = 255 * (1 - ((x - 49.5) ** 2 + (y - 49.5) ** 2) / (2 * 49.5**2))  # every shade about as often
    files["blurred.png"] = np.repeat(smooth.astype(np.uint8)[:, :, None], 3, axis=2)
    files["copy_1.png"] = files["copy_2.png"] = textured(7)
    files["huge.png"] = rng.integers(0, 256, (900, 900, 3)).astype(np.uint8)
    for name, a in files.items():
        (tmp_path / name).write_bytes(png(a))
    audit = ImageAudit(spark, str(tmp_path), verbose=False)
    audit.find_issues()
    assert audit.issues.count() == len(files)
    assert flags(audit, "dark") == {"dark.png"} and flags(audit, "light") == {"light.png"}
    assert flags(audit, "odd_aspect_ratio") == {"wide.png"} and flags(audit, "grayscale") == {"gray.png"}
    assert flags(audit, "exact_duplicates") == {"copy_1.png", "copy_2.png"} and flags(audit, "near_duplicates") == set()
    assert "blurred.png" in flags(audit, "blurry") and "huge.png" in flags(audit, "odd_size")
    counts = {r["issue_type"]: r["num_images"] for r in audit.issue_summary.collect()}
    assert set(counts) == set(DEFAULTS) and counts["exact_duplicates"] == 2
    assert len(audit.issues.columns) == 3 + 2 * len(DEFAULTS)
    assert audit.info["exact_duplicates"]["num_sets"] == 1
    assert [len(r["members"]) for r in audit.info["exact_duplicates"]["sets"].collect()] == [2]
    assert set(audit.get_stats()) == {"brightness", "aspect_ratio", "entropy", "blurriness", "color_space", "size"}

    shown = audit.report(num_images=2)
    assert shown.where("issue_type = 'dark'").first()["image"]["height"] == 100
    assert audit.report(issue_types=["dark"], max_prevalence=0.01, verbosity=0).count() == 0
    with pytest.raises(ValueError):
        audit.report(verbosity=7)
    assert audit.visualize(issue_types=["odd_size"], num_images=1, show_id=True).first()["title"].split("\n")[1].startswith("id : ")
    assert audit.visualize(issue_types=["exact_duplicates"]).orderBy("rank").first()["title"] == "copy_1.png"
    assert audit.visualize(num_images=3, seed=1).count() == 3
    some = [r["image_id"] for r in audit.issues.limit(2).collect()]
    assert [r["image_id"] for r in audit.visualize(indices=some).collect()] == some
    for bad in ({"issue_types": []}, {"image_files": []}):
        with pytest.raises(ValueError):
            audit.visualize(**bad)

    # Again with another threshold: scored anew from the stored properties.
    audit.find_issues({"dark": {"threshold": 0.9}})
    assert len(flags(audit, "dark")) > 1 and flags(audit, "grayscale") == {"gray.png"}

    path = str(tmp_path / "saved")
    audit.save(path)
    with pytest.raises(FileExistsError):
        audit.save(path)
    audit.save(path, force=True)
    again = ImageAudit.load(spark, path, data_path=str(tmp_path))
    key = lambda a: sorted(map(tuple, a.issues.collect()))
    assert key(again) == key(audit)
    again.find_issues({"odd_size": {"threshold": 0.1}})
    with pytest.raises(ValueError):
        ImageAudit.load(spark, path + "x")


def test_near_without_exact(spark, folder):
    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues({"near_duplicates": {}})
    assert audit.issues.columns == ["image_id", "ord", "name", "near_duplicates_score", "is_near_duplicates_issue"]
    assert "exact_duplicates" in audit.info
    audit.find_issues({"light": {}, "dark": {}})
    assert set(audit.info["statistics"]) == {"brightness"}


@pytest.mark.parametrize("kind", ["whash", "ahash", "dhash", "chash"])
def test_hash_types(spark, folder, kind):
    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues({"near_duplicates": {"hash_type": kind, "hash_size": 8}})
    assert audit.issues.count() == 20


def test_sources(spark, folder):
    paths = list_files(spark, str(folder))
    assert len(paths) == 20 and paths == sorted(paths)
    chosen = [paths[3], paths[0]]
    rows = from_files(spark, chosen).orderBy("ord").collect()
    assert [r["image_id"] for r in rows] == chosen
    with pytest.raises(ValueError):
        from_files(spark, [paths[0], paths[0]])
    gone = from_files(spark, [paths[0], str(folder / "none.png")], {"ignore_missing_keys": "true"})
    assert gone.count() == 1
    frame = from_folder(spark, str(folder)).select(F.col("image").alias("picture"))
    audit = ImageAudit(spark, frame=frame, image_key="picture", verbose=False)
    assert sorted(r["image_id"] for r in audit.images.collect()) == list(range(20))
    with pytest.raises(ValueError):
        ImageAudit(spark, frame=frame, image_key="image")
    with pytest.raises(ValueError):
        ImageAudit(spark)
    (folder / "empty").mkdir()
    with pytest.raises(ValueError):
        ImageAudit(spark, str(folder / "empty"))


def test_extensions_and_unreadable(spark, folder):
    (folder / "notes.txt").write_text("x")
    (folder / "broken.png").write_bytes(b"no image")
    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues()
    row = audit.issues.where("name = 'broken.png'").first()
    assert audit.issues.count() == 21 and row["dark_score"] is None and not row["is_dark_issue"] and not row["is_exact_duplicates_issue"]


def test_odd_size_thresholds(spark):
    def run(sizes, threshold):
        df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sizes)], "image_id int, size double")
        df = df.crossJoin(exact_quantiles(df, "size", (0.25, 0.75)).select(*scores.size_fences(F.col("q"), 3.0)))
        return df.where(scores.flag(scores.size_score(F.col("size")), scores.size_threshold(threshold))).count()

    assert run([300] * 10, None) == 0
    assert run([300] * 10 + [400], None) == 1 and run([300] * 10 + [200], None) == 1
    five = [300] * 10 + [100, 200, 300, 400, 500]
    assert run(five, 0.5) == 2 and run(five, None) == 4


def test_score_expressions(spark):
    df = spark.createDataFrame([(x, x) for x in (0.5, 0.3, 0.9, 0.1, 0.2)], "brightness_perc_5 double, brightness_perc_99 double")
    assert [round(r[0], 6) for r in df.select(scores.light_score()).collect()] == [0.5, 0.7, 0.1, 0.9, 0.8]
    assert [r[0] for r in df.select(scores.dark_score()).collect()] == [0.5, 0.3, 0.9, 0.1, 0.2]
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, None)], "s double")
    assert [r[0] for r in df.select(scores.flag(F.col("s"), 0.3)).collect()] == [True, True, False, False, False]


def test_near_minus_exact_agrees_with_lists(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i, None if rng.random() < 0.1 else f"e{rng.integers(0, 60)}", None if rng.random() < 0.1 else f"n{rng.integers(0, 40)}") for i in range(200)]
    rows += [(200 + i, 200 + i, f"E{i // 3}", f"N{i // 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "image_id int, ord int, exact string, near string")
    lists = lambda k: [g for g in {h: [r[0] for r in rows if r[k] == h] for h in {r[k] for r in rows} - {None}}.values() if len(g) > 1]
    want = sorted(g for g in lists(3) if g not in lists(2))
    got = duplicates.as_lists(duplicates.members(df, duplicates.near_only(df, "near", "exact"), "near"))
    assert sorted(r["members"] for r in got.collect()) == want


def test_duplicate_scores(spark):
    df = spark.createDataFrame([(i, i, h) for i, h in enumerate("aabbb") ] + [(5 + i, 5 + i, f"u{i}") for i in range(6)], "image_id int, ord int, h string")
    out = duplicates.flagged(df, duplicates.set_sizes(df, "h"), "h", "exact_duplicates").orderBy("image_id").collect()
    assert [round(r[score_column("exact_duplicates")], 4) for r in out] == [0.5, 0.5] + [0.3333] * 3 + [1.0] * 6
    assert sum(r[flag_column("exact_duplicates")] for r in out) == 5


@pytest.mark.parametrize("common", [0, 1, 2])
@pytest.mark.parametrize("overwrite", [True, False])
def test_merged(spark, common, overwrite):
    old = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "image_id int, a double, b double")
    names = [("a", "b")[k] if k < common else f"n{k}" for k in range(3)]
    new = spark.createDataFrame([(i, 7.0, 8.0, 9.0) for i in range(4)], ["image_id", *names])
    row = summary.merged(old, new, overwrite=overwrite).where("image_id = 0").first().asDict()
    assert set(row) == {"image_id", "a", "b", *names}
    assert row["a"] == (7.0 if common and overwrite else 1.0)


def test_params():
    assert merged_params("blurry", {"threshold": 0.1, "color_threshold": None}) == {"threshold": 0.1, "normalizing_factor": 0.01, "color_threshold": 0.18}
    assert merged_params("dark", {"threshold": 1})["threshold"] == 1.0
    for issue, bad in (("dark", {"unknown": 1}), ("dark", {"threshold": "x"}), ("near_duplicates", {"hash_type": "sha"}), ("near_duplicates", {"hash_size": 2.5}), ("near_duplicates", {"hash_type": "whash", "hash_size": 6})):
        with pytest.raises(ValueError):
            merged_params(issue, bad)


def test_custom_detector(spark, folder):
    @register_detector("custom")
    class Custom(Detector):
        def default_params(self):
            return {"threshold": 0.4}

        def transform(self, images, params):
            score = F.length("name") / 100
            return images.select("image_id", score.alias("custom_score"), (score < params["threshold"]).alias("is_custom_issue"))

    @register_detector("custom")
    class Other(Detector):
        def default_params(self):
            return {}

        def transform(self, images, params):
            raise AssertionError

    assert type(registry.detector("custom")) is Custom and Other is Custom
    assert "custom" in ImageAudit.list_possible_issue_types() and "custom" not in ImageAudit.list_default_issue_types()
    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues({"custom": {}, "dark": {}})
    assert audit.issues.where("is_custom_issue").count() == 20
    with pytest.raises(KeyError):
        audit.find_issues({"nothing": {}})
    with pytest.raises(ValueError):
        register_detector("bad")(int)
    with pytest.raises(ValueError):
        registry.detector(["custom"])


def test_detector_of_mean_pixels(spark, folder):
    """A custom detector that reads pixels: their mean as a share of white."""

    @register_detector("pale")
    class Pale(Detector):
        def default_params(self):
            return {"threshold": 0.45}

        def transform(self, images, params):
            def means(batches):
                for b in batches:
                    mean = [np.frombuffer(x["data"], np.uint8).mean() / 255 for x in b["image"]]
                    yield pd.DataFrame({"image_id": b["image_id"], "pale_score": mean})

            got = images.select("image_id", "image").mapInPandas(means, "image_id string, pale_score double")
            return got.withColumn("is_pale_issue", F.col("pale_score") < params["threshold"])

    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues({"pale": {"threshold": 0.5}})
    rows = audit.issues.collect()
    assert len(rows) == 20 and all(0.45 < r["pale_score"] < 0.55 and r["is_pale_issue"] == (r["pale_score"] < 0.5) for r in rows)


def test_text_helpers():
    assert "N/A" in markdown([{"a": 1, "b": None}, {"a": 2, "b": 3.0}]) and markdown([]) == ""
    long = "s3a://store/photos/2031/spring/harbour/north-pier-{}.jpeg"
    assert truncated([long.format(4), long.format(5)], 2) == ["...north-pier-4.jpeg", "...north-pier-5.jpeg"]
    assert truncated(["a.png", "bc.png"], 2) == ["a.png", "bc.png"]
    assert truncated(["/volumes/backup/north-pier-4.jpeg", long.format(5)], 2) == ["/volumes/backup/n...", "s3a://store/photo..."]


def test_score_stream(spark, folder):
    from prismal.streaming import property_stream, score_stream

    images = from_folder(spark, str(folder))
    images.write.parquet(str(folder / "parquet"))
    stream = spark.readStream.schema(images.schema).parquet(str(folder / "parquet"))
    q = score_stream(stream, {"dark": {}, "grayscale": {}}).writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from scores").count() == 20
    assert property_stream(images, ["entropy"]).count() == 20
    with pytest.raises(ValueError):
        score_stream(stream, {"odd_size": {}})


def test_encoded_bytes_and_image_stream(spark, folder):
    from prismal.streaming import image_stream, score_stream

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
    both = raw.select("path", F.struct(F.col("content").alias("bytes"), F.col("path")).alias("image"))
    more = "path string, image struct<bytes: binary, path: string>"
    both = both.union(spark.createDataFrame([("broken", (bytearray(b"x"), "p")), ("none", None)], more))
    audit = ImageAudit(spark, frame=both, image_key="image", id_column="path", verbose=False)
    audit.find_issues()
    files = ImageAudit(spark, str(folder), verbose=False)
    files.find_issues()
    key = lambda a: sorted(tuple(r)[3:] for r in a.issues.where("dark_score is not null").collect())
    assert key(audit) == key(files) and audit.issues.count() == 22
    q = score_stream(image_stream(spark, str(folder)), {"dark": {}}).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from seen where dark_score is not null").count() == 20


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [5.0] * 50 + [1.0, 9.0, None], list(np.random.default_rng(2).normal(size=3000).round(2)), list(range(2000))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = exact_quantiles(df, "x", shares).collect()
    known = [v for v in values if v is not None]
    assert len(got) == 1
    assert got[0]["q"] == ([None] * 5 if not known else pytest.approx(np.quantile(known, shares).tolist()))


def test_row_numbers(spark):
    from prismal.sources.images import numbered

    df = spark.range(0, 1000, numPartitions=7).where("id % 3 = 0").withColumnRenamed("id", "x")
    assert [tuple(r) for r in numbered(df).collect()] == [(k, 3 * k) for k in range(334)]
    moved = numbered(df.repartition(5))
    assert sorted(r["image_id"] for r in moved.collect()) == list(range(334))
    assert numbered(df.where("x < 0")).count() == 0


def test_pairs_as_images(spark):
    image = png(np.full((4, 5, 3), 9, np.uint8))
    df = spark.createDataFrame([((bytearray(image), 1),), ((None, 0),)], "pair struct<picture: binary, label: int>")
    rows = {r["image_id"]: r["image"] for r in ImageAudit(spark, frame=df, image_key="pair", verbose=False).images.collect()}
    assert sum(i is not None for i in rows.values()) == 1 and set(rows) == {0, 1}
    with pytest.raises(ValueError):
        ImageAudit(spark, frame=spark.createDataFrame([(1,)], "image int"), image_key="image")


def test_pixel_detector_in_the_shared_pass(spark, folder):
    @register_detector("mean_red")
    class MeanRed(PixelDetector):
        def kernel(self, image):
            return image[:, :, 0].mean() / 255

    audit = ImageAudit(spark, str(folder), verbose=False)
    audit.find_issues({"mean_red": {"threshold": 0.5}, "dark": {}})
    rows = audit.issues.collect()
    assert all(0.4 < r["mean_red_score"] < 0.6 and r["is_mean_red_issue"] == (r["mean_red_score"] < 0.5) for r in rows)
    assert "mean_red_value" in audit.info["mean_red"].columns and "mean_red_value" in audit._properties.columns
    with pytest.raises(ValueError):
        audit.find_issues({"mean_red": {"limit": 1}})
    with pytest.raises(ValueError):
        audit.find_issues({"mean_red": {"threshold": "high"}})
    audit.close()
    assert not audit._written


def test_deep_merge_and_loaded_detectors(tmp_path, monkeypatch):
    old = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert summary.deep_merged(old, {"a": {"c": {"f": 4}}, "e": {"g": 5}}) == {"a": {"b": 1, "c": {"d": 2, "f": 4}}, "e": {"g": 5}}
    assert old == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    (tmp_path / "plugged").mkdir()
    (tmp_path / "plugged" / "__init__.py").write_text("")
    (tmp_path / "plugged" / "one.py").write_text("from prismal import PixelDetector, register_detector\n\n@register_detector('plugged_one')\nclass One(PixelDetector):\n    def kernel(self, image):\n        return 1.0\n")
    (tmp_path / "plugged" / "_skipped.py").write_text("raise AssertionError\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert registry.load_detectors("plugged") == ["plugged_one"]


def test_titles_of_sets_and_contact_sheet(spark, tmp_path):
    from prismal.functions.decode import decode
    from prismal.plans import grid

    a, b = np.full((30, 200, 3), 50, np.uint8), np.full((20, 20), 90, np.uint8)
    names = {"a-very-long-beginning-of-a-name-1.png": a, "a-very-long-beginning-of-a-name-2.png": a, "b1.png": b, "b2.png": b, "b3.png": b}
    for name, image in names.items():
        (tmp_path / name).write_bytes(png(image))
    audit = ImageAudit(spark, str(tmp_path), verbose=False)
    audit.find_issues({"exact_duplicates": {}})
    view = audit.visualize(issue_types=["exact_duplicates"])
    rows = view.collect()
    assert [r["title"] for r in rows] == ["b1.png", "b2.png", "b3.png", *truncated(sorted(names)[:2], 2)]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    sheet = grid.contact_sheet(view, columns=2)
    assert sheet.shape == (3 * 100 + 4, 2 * 100 + 4, 3) and (sheet[4:24, 4:24] == 90).all() and (decode(grid.png(sheet)) == sheet).all()
    assert grid.contact_sheet(view.limit(0)) is None


def test_audit_of_what_a_stream_has_stored(spark, folder, tmp_path_factory):
    from prismal.streaming import image_stream, store_properties

    out, marks = str(tmp_path_factory.mktemp("stored") / "p"), str(tmp_path_factory.mktemp("marks"))

    def run():
        q = store_properties(image_stream(spark, str(folder)), out, marks)
        q.processAllAvailable()
        q.stop()

    run()
    first = sorted(p for p in folder.rglob("*.png"))[0]
    (folder / "late.png").write_bytes(first.read_bytes())
    (folder / "huge.png").write_bytes(png(np.zeros((1000, 1000), np.uint8)))
    run()
    audit = ImageAudit.of_properties(spark, spark.read.parquet(out))
    audit.find_issues(verbose=False)
    assert audit.issues.count() == 22
    assert flags(audit, "exact_duplicates") == {"late.png", first.name} and flags(audit, "odd_size") == {"huge.png"}
    with pytest.raises(ValueError):
        audit.find_issues({"near_duplicates": {"hash_type": "ahash"}})
