"""Whole runs over small images written here: a training run, a two-stage run, a coverage run, inference, streaming."""

import json

import numpy as np
import pytest

from tessera import cli
from tessera.plans import inference, training
from tessera.plans.settings import Run
from tessera.sources import metadata
from tessera.sources.artifacts import Artifacts, heat_map, png

COLOURS = {"nv": (90, 60, 60), "mel": (40, 40, 50), "bkl": (60, 110, 160)}


def picture(rng, dx, size=24):
    y, x = np.mgrid[:size, :size]
    image = np.full((size, size, 3), 210.0) + rng.normal(0, 3, (size, size, 3))
    inside = (y - size / 2) ** 2 + (x - size / 2) ** 2 < {"nv": 5, "mel": 9, "bkl": 7}[dx] ** 2
    image[inside] = np.array(COLOURS[dx]) + rng.normal(0, 3, (inside.sum(), 3))
    return image.clip(0, 255).astype(np.uint8)


def jpeg(spark, path, image):
    """Write a JPEG of the highest quality that the JVM's encoder gives by default."""
    io, stream = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io
    decoded = io.read(stream.ByteArrayInputStream(bytearray(png(image))))
    assert io.write(decoded, "jpg", stream.File(str(path)))


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root, rng, rows = tmp_path_factory.mktemp("images"), np.random.default_rng(0), []
    for k in (1, 2):
        (root / f"HAM10000_images_part_{k}").mkdir()
    for i in range(36):
        dx = ("nv", "mel", "bkl")[i % 3]
        path = root / f"HAM10000_images_part_{1 + i % 2}" / f"I{i}.jpg"
        jpeg(spark, path, picture(rng, dx))
        assert path.read_bytes()[:3] == b"\xff\xd8\xff"
        rows.append(f"L{i},I{i},{dx},50")
    (root / "HAM10000_metadata.csv").write_text("lesion_id,image_id,dx,age\n" + "\n".join(rows) + "\n")
    return root


def small(dataset, out, **parts):
    base = {
        "samples": {"per_class": 12, "train": 8, "val": 4}, "preparation": {"size": 24, "hair": False}, "segmentation": {"steps": 10},
        "texture": {"lbp_roi": False, "lbp_bimf1": False}, "learner": {"probability": True}, "balancing": {"smote_k": 3},
    }
    return Run(str(dataset), str(out)).with_(**{k: base.get(k, {}) | parts.get(k, {}) for k in {*base, *parts}})


def test_run_and_inference(spark, dataset, tmp_path):
    config = small(dataset, tmp_path / "run")
    result = training.run(spark, config)
    assert result["accuracy"] > 0.7
    out = Artifacts(spark, config.out)
    for name in ("metrics.json", "classification_report.csv", "confusion_matrix.csv", "confusion_matrix.png", "class_distribution_train.csv", "class_distribution_val.csv", "model.zip", "feature_columns.json", "label_classes.json", "run_config.json"):
        assert out.exists(name), name
    assert out.read("class_distribution_train.csv").decode() == "class,count\nbkl,8\nmel,8\nnv,8\n"
    assert out.read_json("metrics.json") == result and Run.from_json(out.read("run_config.json").decode()) == config
    one = inference.predict_one(spark, config.out, str(dataset / "HAM10000_images_part_1" / "I0.jpg"))
    assert one["prediction"] in COLOURS and sum(one["probabilities"].values()) == pytest.approx(1, abs=1e-5)
    assert json.loads(inference.as_json(one)) == one
    # images that arrive as a stream get the same predictions, each once
    from tessera.streaming.arrivals import predict_arrivals

    source, said = tmp_path / "arrivals", str(tmp_path / "said")
    source.mkdir()
    bundle = inference.load(spark, config.out)
    for turn, names in enumerate((["a", "b", "c"], ["d"])):
        for k, name in enumerate(names):
            jpeg(spark, source / f"{name}.jpg", picture(np.random.default_rng(9 + turn + k), "mel"))
        predict_arrivals(spark, str(source), bundle, said, str(tmp_path / "state"), at_once=2).awaitTermination(120)
    rows = {r["path"].rpartition("/")[2]: r["pred"] for r in spark.read.parquet(said).collect()}
    assert spark.read.parquet(said).count() == 4 and set(rows) == {f"{n}.jpg" for n in "abcd"}
    assert all(rows[n] == inference.predict_one(spark, config.out, str(source / n))["prediction"] for n in rows)
    # stored feature names that don't fit are noticed
    out.write_json("feature_columns.json", ["x"])
    with pytest.raises(ValueError, match="feature columns"):
        inference.load(spark, config.out)


def test_two_stages(spark, dataset, tmp_path):
    config = small(dataset, tmp_path / "two", samples={"split": "stratified_ratio", "val_ratio": 0.25}, decision={"two_stage": True, "minority": ("mel",), "steps": 5, "second": "smote"})
    training.run(spark, config)
    out = Artifacts(spark, config.out)
    assert set(out.read_json("thresholds.json")) == set(COLOURS) and out.exists("argmax_metrics.json") and out.exists("thresholded_metrics.json")
    got = inference.predict_one(spark, config.out, str(dataset / "HAM10000_images_part_2" / "I1.jpg"))
    assert set(got["probabilities"]) == set(COLOURS)


def test_rounds(spark, dataset, tmp_path):
    config = small(dataset, tmp_path / "rounds", learner={"kind": "ann", "hidden": (16,), "epochs": 40}, samples={"coverage": True, "per_class": 7, "train": 4, "val": 3})
    summary = training.run(spark, config)
    out = Artifacts(spark, config.out)
    assert summary["rounds"] == 2 and out.read_json("coverage_summary.json") == summary
    assert len(out.read("coverage_metrics.csv").decode().splitlines()) == 3
    assert all(out.exists(n) for n in ("model.zip", "label_classes.json", "round_001/run_config.json", "round_002/metrics.json"))


def test_metadata_errors(spark, dataset, tmp_path):
    (tmp_path / "HAM10000_metadata.csv").write_text("image_id,dx\nI0,nv\nlost,mel\n")
    for k in (1, 2):
        (tmp_path / f"HAM10000_images_part_{k}").symlink_to(dataset / f"HAM10000_images_part_{k}")
    with pytest.raises(FileNotFoundError, match="lost"):
        metadata.load(spark, Run(str(tmp_path), "x").metadata(), Run(str(tmp_path), "x").roots())
    (tmp_path / "HAM10000_metadata.csv").write_text("id,dx\nI0,nv\n")
    with pytest.raises(ValueError, match="image_id"):
        metadata.load(spark, Run(str(tmp_path), "x").metadata(), Run(str(tmp_path), "x").roots())


def test_unreadable_image(spark, dataset, tmp_path):
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    from tessera.functions.features import extract

    images = spark.read.format("image").load(str(tmp_path / "bad.jpg"))
    with pytest.raises(Exception, match="can't read image"):
        extract(images, small(dataset, tmp_path)).collect()


def test_images_are_sampled_before_features(spark, dataset, tmp_path):
    """Ten times the images, half of them unreadable but not drawn: the same number is read and extracted."""
    root, rng = tmp_path / "more", np.random.default_rng(1)
    for k in (1, 2):
        (root / f"HAM10000_images_part_{k}").mkdir(parents=True)
    lines = ["image_id,dx"]
    for i in range(360):
        dx = ("nv", "mel", "bkl")[i % 3]
        path = root / f"HAM10000_images_part_{1 + i % 2}" / f"I{i}.jpg"
        path.write_bytes(png(picture(rng, dx)))  # the decoder goes by content
        lines.append(f"I{i},{dx}")
    (root / "HAM10000_metadata.csv").write_text("\n".join(lines) + "\n")
    run = small(root, tmp_path / "run", samples={"per_class": 6, "train": 4, "val": 2})
    rows = metadata.load(spark, run.metadata(), run.roots()).selectExpr("image_id as id", "dx as label", "image_path")
    drawn = {r["id"] for r in training.sampling.split(rows, run.samples, "label", "id").collect()}
    for i in range(360):
        if f"I{i}" not in drawn:
            (root / f"HAM10000_images_part_{1 + i % 2}" / f"I{i}.jpg").write_bytes(b"no image")
    training.run(spark, run)
    got = {r["id"] for r in spark.read.parquet(f"{run.out}/features.parquet").collect()}
    assert got == drawn and len(got) == 18
    one = metadata.read_images(spark, rows.where("id in ('I0', 'I1')"), run.roots())
    assert one.select("image").count() == 2
    # beyond the limit of listed paths, whole folders are read and joined: the same rows
    assert metadata.read_images(spark, rows.where("id in ('I0', 'I1')"), run.roots(), listed=1).count() == 2


@pytest.mark.parametrize(
    "parts",
    [
        {"texture": {g: False for g in ("lbp_roi", "lbp_bimf1", "glcm", "hsv", "abcd")}}, {"texture": {"method": "var"}}, {"samples": {"split": "stratified_ratio", "val_ratio": 1.0}},
        {"samples": {"split": "x"}}, {"learner": {"kind": "x"}}, {"decision": {"two_stage": True}, "learner": {"kind": "ann"}}, {"decision": {"two_stage": True}},
        {"decision": {"two_stage": True}, "learner": {"probability": True}, "samples": {"coverage": True}}, {"samples": {"coverage": True, "per_class": None}},
        {"balancing": {"strategy": "x"}}, {"learner": {"gamma": "wide"}},
    ],
)
def test_settings_that_cannot_work(parts):
    assert Run("a", "b").checked()
    with pytest.raises(ValueError):
        Run("a", "b").with_(**parts).checked()


def test_command_line():
    args = ["train", "--dataset-root", "d", "--per-class-limit", "0", "--ann-hidden", "8, 4", "--svm-gamma", "0.25", "--disable-hsv", "--minority-classes", "df, vasc", "--disable-hair-removal", "--n-jobs", "3"]
    run = cli.run_of(cli.parser().parse_args(args)).checked()
    assert run.samples.per_class is None and run.learner.hidden == (8, 4) and float(run.learner.gamma) == 0.25 and run.tasks == 3
    assert not run.texture.hsv and not run.preparation.hair and run.preparation.light and run.decision.minority == ("df", "vasc")
    paper = cli.run_of(cli.parser().parse_args([*args, "--paper-mode"]))
    assert paper.learner.kind == "ann" and paper.texture.lbp_roi and not paper.texture.glcm and paper.samples.per_class == 115
    assert cli.run_of(cli.parser().parse_args(["train", "--dataset-root", "d"])) == Run("d", "artifacts")
    assert Run.from_json(paper.to_json()) == paper


def test_feature_names():
    from tessera.functions.features import feature_columns

    names = feature_columns(Run("a", "b").texture)
    assert len(names) == 560 and len(set(names)) == 560 and len(feature_columns(Run("a", "b").paper().texture)) == 512
    assert names[0] == "lbp_roi_0" and names[511] == "lbp_bimf1_255" and names[512:516] == ["glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]
    assert names[516] == "hsv_h_0" and names[540] == "hsv_s_0" and names[-4:] == ["abcd_asymmetry", "abcd_border_irregularity", "abcd_color_var", "abcd_diameter"]


def test_heat_map():
    image = heat_map(np.array([[10, 0], [123, 4]]))
    assert image.shape == (97, 97, 3) and png(image).startswith(b"\x89PNG")


def test_fits_take_any_number_of_rows(spark, tmp_path):
    """No cap on rows: a network in batches, and a machine whose kernel isn't held whole."""
    df = spark.range(20_100).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as label", "array(cast(id % 2 as float), cast(id % 7 as float)) as features")
    learner = Run("a", "b").with_(learner={"hidden": (4,), "epochs": 2}).learner
    model = training.fit_mlp(df, learner)
    assert model.classes == ["a", "b"] and model.scaler.mean[0] == pytest.approx(0.5)
    machine = training.fit_svm(df, learner)
    assert machine.predict(np.array([[0.0, 3.0], [1.0, 3.0]])).tolist() == ["a", "b"]


def test_errors_of_a_prediction_are_not_hidden(spark):
    df = spark.range(40).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as label", "array(cast(id % 2 as float), cast(id % 7 as float)) as features")
    model = training.fit_svm(df, Run("a", "b").learner)
    assert {r["probs"] for r in training.predict(df, model).select("probs").collect()} == {None}
    with pytest.raises(Exception, match="ValueError"):
        training.predict(df.withColumn("features", training.F.expr("array(1f)")), model).collect()
