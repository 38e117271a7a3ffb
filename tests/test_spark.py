"""Operators on small tables: by hand, by invariance, and against SQL on the driver's tables where they are there."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import config as C
from tallyforge import queries, registry
from tallyforge.operators.base import MissingColumn
from tallyforge.operators.completeness import Completeness
from tallyforge.operators.diversity import Diversity
from tallyforge.operators.gap import DomainGap
from tallyforge.operators.representativeness import Representativeness, normal_cdf_column
from tallyforge.operators.visual import ImageFeatures
from tallyforge.plans import job
from tallyforge.sources import readers
from tests.test_plain import png

DATA = "/root/testdata/sf0.001"


def one(df):
    return df.first().asDict()


def test_completeness(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    row = one(Completeness({"name": "c", "include_metadata": True}).compute(job.tagged(df, "d")))
    assert row["completeness_x"] == 0.5 and row["completeness_s"] == 0.75 and row["completeness_overall"] == 0.625
    assert json.loads(row["_metadata_c"])["total_samples_per_column"] == 4
    empty = spark.createDataFrame([(None,)], "x float")
    assert one(Completeness({"name": "c"}).compute(job.tagged(empty, "d")))["completeness_x"] == 0.0


def test_missing_column(spark):
    df = job.tagged(spark.createDataFrame([(1,)], "x int"), "d")
    with pytest.raises(MissingColumn):
        Completeness({"name": "c", "columns": {"input": ["y"]}}, C.ErrorsConfig(default="fail_fast")).compute(df)
    assert one(Completeness({"name": "c", "columns": {"input": ["x", "y"]}}).compute(df))["completeness_overall"] == 1.0


def test_diversity_of_null_and_golden_shape(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    row = one(Diversity({"name": "d", "columns": {"input": ["v"]}}).compute(job.tagged(df, "d")))
    assert row["v_richness"] == 3 and row["v_gini"] == pytest.approx(1 - (4 + 1 + 1) / 16) and row["v_simpson"] == pytest.approx(1 - 2 / 12)
    assert row["v_shannon"] == pytest.approx(-(0.5 * np.log(0.5) + 2 * 0.25 * np.log(0.25)))
    single = one(Diversity({"name": "d", "columns": {"input": ["v"]}}).compute(job.tagged(df.limit(1), "d")))
    assert single["v_simpson"] == 0.0


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(5)
    df = job.tagged(spark.createDataFrame([(float(x), int(x) % 3) for x in rng.normal(10, 2, 300)], "x double, k int").repartition(parts), "d")
    r = {"name": "r", "columns": {"input": ["x"]}, "mean_std_estimation": "from_all_data"}
    row = one(job.compute_metrics(df, [Completeness({"name": "c"}), Diversity({"name": "v", "columns": {"input": ["k"]}}), Representativeness(r)]))
    known = test_partitions_do_not_matter.__dict__.setdefault("row", {k: v for k, v in row.items()})
    for k, v in row.items():
        assert v == known[k] or v == pytest.approx(known[k], rel=1e-9), k


def test_representativeness_tells_distributions_apart(spark):
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(0, 1, 4000), "two": np.concatenate([rng.normal(-5, 0.3, 2000), rng.normal(5, 0.3, 2000)])}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("normal", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    config = C.DataLoaderConfig.model_validate({"name": "t", "path": "-", "split": {"by": "k"}})
    table = readers.load(spark, config, df=df).df
    out = {r["selection"]: r for r in Representativeness({"name": "r", "columns": {"input": ["x"]}, "mean_std_estimation": "from_all_data"}).compute(table).collect()}
    assert out["t_normal"]["x_grte_grte_value"] > 0.9 > 0.3 > out["t_two"]["x_grte_grte_value"]
    assert out["t_normal"]["x_chi-square_interpretation"] == "follows_distribution" and out["t_two"]["x_chi-square_interpretation"] == "does_not_follow_distribution"
    assert out["t_normal"]["x_kolmogorov-smirnov_sample_size"] == 4000 and out["t_two"]["x_kolmogorov-smirnov_p_value"] < 1e-6
    xs = np.sort(data["normal"])
    z = np.array([0.5 * (1 + __import__("math").erf((x - xs.mean()) / xs.std() / 2**0.5)) for x in xs])
    d = max((np.arange(1, 4001) / 4000 - z).max(), (z - np.arange(4000) / 4000).max())
    assert out["t_normal"]["x_kolmogorov-smirnov_statistic"] == pytest.approx(d, abs=1e-9)
    with pytest.raises(ValueError, match="aren't given"):
        Representativeness({"name": "r", "columns": {"input": ["x"]}, "mean_std_estimation": "user_provided"}).compute(table)


def test_normal_cdf_in_the_jvm(spark):
    from tallyforge.functions.stats import normal_cdf

    zs = [-40.0, -8.0, -4.0, -3.99, -1.0, 0.0, 0.5, 2.5, 4.0, 6.0, 40.0]
    out = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf_column(F.col("z")).alias("f")).collect()
    for r in out:
        assert r["f"] == pytest.approx(normal_cdf(r["z"]), abs=1e-12)


def vectors(spark, shift, n=60, d=8, same=False):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 0.3, (n, d))
    b = a if same else rng.normal(0, 0.3, (n, d)) + shift
    frame = lambda m: spark.createDataFrame([(x.tolist(),) for x in m], "emb array<double>")
    return frame(a), frame(b), a, b


@pytest.mark.parametrize("metric", ["mmd_linear", "klmvn_diag", "fid", "wasserstein_1d", "mmd_rbf", "mmd_poly", "cmd"])
def test_gaps_grow_with_a_shift(spark, metric):
    p = DomainGap({"name": "g", "columns": {"input": ["emb"]}, "distance": {"metric": metric}, "summary": {"channels": {"emb": 8}}})
    values = [job.gap_between(spark, *vectors(spark, s)[:2], p)[metric] for s in (0.1, 0.5, 2.0)]
    assert values[0] < values[1] < values[2]
    assert job.gap_between(spark, *vectors(spark, 0, same=True)[:2], p)[metric] == pytest.approx(0, abs=1e-5)


def test_gaps_by_numpy(spark):
    s, t, a, b = vectors(spark, 0.4)
    gap = lambda m, **o: job.gap_between(spark, s, t, DomainGap({"name": "g", "columns": {"input": ["emb"]}, "distance": {"metric": m, **o}}))[m]
    k = lambda x, y: np.exp(-np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))).mean()
    assert gap("mmd_rbf") == pytest.approx(k(a, a) + k(b, b) - 2 * k(a, b))
    v, w = a.var(0), b.var(0)
    assert gap("klmvn_diag") == pytest.approx(0.5 * ((v / w - 1 - np.log(v / w)).sum() + ((b.mean(0) - a.mean(0)) ** 2 / w).sum()))
    row = job.gap_between(spark, s, t, DomainGap({"name": "g", "columns": {"input": ["none"]}, "distance": {"metric": "fid"}}))
    assert row["note"].startswith("missing keys")
    assert job.gap_between(spark, s.limit(0), t, DomainGap({"name": "g", "columns": {"input": ["emb"]}, "distance": {"metric": "fid"}})) == {}


def test_pictures(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(png(pixels, 2, [0]))), (2, bytearray(b"broken")), (3, None)], "id int, image_bytes binary")
    quiet = C.ErrorsConfig(images=C.ImageErrorsConfig(on_unsupported_format="silent_fail"))
    p = ImageFeatures({"name": "v", "columns": {"rename": [{"from": "image_bytes_blur", "to": "sharp"}]}}, quiet)
    out = {r["id"]: r for r in p.add(df).collect()}
    assert 0 < out[1]["image_bytes_luminosity"] < 1 and out[1]["sharp"] > 0 and np.isnan(out[2]["image_bytes_entropy"]) and np.isnan(out[3]["sharp"])
    with pytest.raises(RuntimeError):
        p.failures(p.add(df))


def test_registry():
    assert {"completeness", "diversity", "representativeness"} <= set(registry.found("metrics"))
    with pytest.raises(ValueError, match="no 'x'"):
        registry.get("metrics", "x")


def test_job_from_files(spark, tmp_path):
    import yaml

    from tallyforge.cli import main

    (tmp_path / "a.csv").write_text("k,x\nu,1\nu,\nv,3\n")
    config = {
        "dataloaders": {"loaders": [{"name": "t", "type": "csv", "path": str(tmp_path / "a.csv"), "split": {"by": "k"}, "transform": [{"column": "x", "to_type": "float64", "in_place": True}]}]},
        "metrics": {"processors": [{"type": "completeness", "name": "c", "columns": {"input": ["x"]}}], "outputs": {"path": str(tmp_path / "m")}},
        "features": {"outputs": {"path": str(tmp_path / "f" / "{}-{}")}},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert main(["process", "-p", str(tmp_path / "c.yaml"), "--save-config", str(tmp_path / "saved.yaml")]) == 0
    assert {r["selection"]: r["completeness_x"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"t_u": 0.5, "t_v": 1.0}
    assert spark.read.parquet(str(tmp_path / "f" / "features")).count() == 3
    assert yaml.safe_load((tmp_path / "saved.yaml").read_text()) == config
    assert job.profile(spark, spark.createDataFrame([], "x int"), [Completeness({"name": "c"})]) == {}


def test_store_settings():
    s = C.StorageConfig(type="s3", bucket="b", access_key="k", secret_key="s", region="r", endpoint="e", retry={"max_attempts": 5})
    assert readers.located("x/y", s) == "s3a://b/x/y" and readers.located("b/x", s) == "s3a://b/x"
    assert readers.store_options(s)["fs.s3a.attempts.maximum"] == "5"
    assert "Anonymous" in readers.store_options(C.StorageConfig(type="s3", bucket="b", anonymous=True))["fs.s3a.aws.credentials.provider"]


def test_stream(spark, tmp_path):
    from tallyforge.streaming.monitor import monitor

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.0D AS x UNION ALL SELECT timestamp'2024-01-01 00:20:00', CAST('NaN' AS DOUBLE)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / "in"))
    q = monitor(stream, "ts", ["x"]).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("seen").first()
    assert row["rows"] == 2 and row["completeness_x"] == 0.5 and row["x_mean"] == 1.0


SLOW = {"gap_pad"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_queries_against_sql(spark, name):
    import duckdb

    with duckdb.connect() as c:
        for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        names = sorted(want.columns)
        want = sorted(map(str, want.select(*names).fetchall()))
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == names
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want


def test_sampled_distance_is_near(spark):
    rng = np.random.default_rng(9)
    df = job.tagged(spark.createDataFrame([(float(x),) for x in rng.uniform(0, 1, 5000)], "x double").repartition(7), "d")
    p = Representativeness({"name": "r", "columns": {"input": ["x"]}, "distribution": "uniform", "metrics": ["kolmogorov-smirnov"], "mean_std_estimation": "from_all_data", "ks": {"exact": False, "sample_size": 200}})
    row = one(p.compute(df))
    assert row["x_kolmogorov-smirnov_sample_size"] == 200 and row["x_kolmogorov-smirnov_statistic"] < 0.15 and row["x_kolmogorov-smirnov_note"] == "approximated_from_random_samples"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_whole_job_takes_all_labels(spark):
    assert queries.job_metrics(spark, DATA).count() == 10 and queries.job_gap(spark, DATA).count() == 2 * 45


def test_first_batches_are_by_loader(spark):
    """Each loader's own batch size and order."""
    df = job.tagged(spark.createDataFrame([(i, float(i)) for i in range(100)], "id int, x double"), "a", 0)
    other = job.tagged(spark.createDataFrame([(i, float(1000 + i)) for i in range(100)], "id int, x double"), "b", 1)
    p = Representativeness({"name": "r", "columns": {"input": ["x"]}, "mean_std_estimation": "from_first_batch"})
    params, _ = p.parameters(df.union(other), batches=[(["a"], 10, "id"), (["b"], 20, "x")])
    assert params["a", "x"]["mean"] == 4.5 and params["b", "x"]["mean"] == 1009.5 and params["b", "x"]["max"] == 1019


def test_counts_by_chance_follow_the_law():
    from tallyforge.operators.representativeness import expected_counts

    edges = np.array([-np.inf, -1.0, 0.0, 1.0, np.inf])
    p = {"mean": 0.0, "std": 1.0, "min": 0.0, "max": 1.0}
    n = 10**12
    drawn, want = (expected_counts("normal", m, edges, p, n, 3) for m in ("monte_carlo", "theoretical"))
    assert drawn.sum() == n and np.abs(drawn - want).max() < 10 * np.sqrt(n) and (drawn != want).any()
    assert expected_counts("uniform", "monte_carlo", np.array([0.0, 0.25, 0.5]), p, 1000, 3).sum() < 700


def test_missing_files(spark, tmp_path):
    """ERR-4: an error only where the policy of tables says so; else no features."""
    pixels = np.random.default_rng(3).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels, 2, [0]))
    df = spark.createDataFrame([(1, str(tmp_path / "a.png")), (2, str(tmp_path / "b.png")), (3, str(tmp_path / "no" / "c.png"))], "id int, path string")
    config = {"name": "v", "columns": {"input": ["path"]}}
    out = {r["id"]: r for r in ImageFeatures(config, C.ErrorsConfig(tabular=C.TabularErrorsConfig(on_file_not_found="silent_fail"))).add(df).collect()}
    assert out[1]["path_blur"] > 0 and np.isnan(out[2]["path_blur"]) and np.isnan(out[3]["path_blur"]) and out[2]["path"].endswith("b.png")
    strict = C.ErrorsConfig(tabular=C.TabularErrorsConfig(on_file_not_found="fail_fast"))
    for rows in (df, df.where("id = 3")):
        with pytest.raises(Exception, match="Path does not exist"):
            ImageFeatures(config, strict).add(rows).collect()


def test_failures_of_embeddings_and_without_a_job(spark):
    """ERR-2 for vectors, and for a profile of one table."""
    from tallyforge.operators.embedding import Embeddings

    good = bytearray(png(np.random.default_rng(3).integers(1, 256, (9, 8, 3)).astype(np.uint8), 2, [0]))
    df = spark.createDataFrame([(1, good), (2, bytearray(b"broken")), (3, good)], "id int, image_bytes binary")
    quiet = C.ErrorsConfig(images=C.ImageErrorsConfig(on_unsupported_format="silent_fail", on_decode_failure="silent_fail"))
    p = Embeddings({"name": "e", "columns": {"input": ["image_bytes"]}, "model": {"arch": "projection"}, "infer": {"width": 8, "height": 8}}, quiet)
    with pytest.raises(RuntimeError, match="1 of 3"):
        p.failures(p.add(df))
    with pytest.raises(RuntimeError, match="1 of 3"):
        job.profile(spark, df, [p, Completeness({"name": "c", "columns": {"input": ["id"]}})])
    kept = job.profile(spark, df.where("id <> 2"), [p, Completeness({"name": "c", "columns": {"input": ["id"]}})])
    assert kept["completeness_id"] == 1.0 and kept["features"].count() == 2


def test_frechet_distance_over_several_strips(spark, monkeypatch):
    """Matrices that are added by strips and in steps are those of numpy."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (300, 150)), rng.normal(0.2, 1.3, (200, 150))
    rows = [(0, "a", v.tolist()) for v in x] + [(1, "b", v.tolist()) for v in y]
    df = spark.createDataFrame(rows, "selection_ix int, selection string, emb array<double>").repartition(6)
    p = DomainGap({"name": "g", "columns": {"input": ["emb"]}, "distance": {"metric": "fid"}})
    cov = [np.cov(m.T, bias=True) + 1e-6 * np.eye(150) for m in (x, y)]
    root = np.linalg.eigvals(cov[0] @ cov[1])
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * np.sqrt(np.maximum(root.real, 0)).sum()
    assert one(p.compute(df))["fid"] == pytest.approx(want, rel=1e-6)
