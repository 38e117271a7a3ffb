"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import config as C
from tallyforge.functions import images, stats
from tallyforge.operators import gap
from tallyforge.operators.completeness import Completeness
from tallyforge.operators.diversity import Diversity
from tallyforge.operators.representativeness import Representativeness
from tallyforge.plans import job
from tallyforge.sources.readers import KEYS_NAMES, load
from tallyforge.sources.sinks import features_table, gap_table, metrics_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), digits) if kind == "double" else F.col(f"`{c}`")).alias(c.replace("-", "_")) for c, kind in df.dtypes))


def selections(spark: SparkSession, sf_dir: str, table: str, df: DataFrame | None = None, **options) -> DataFrame:
    config = C.DataLoaderConfig.model_validate({"name": table, "type": "parquet", "path": f"{sf_dir}/{table}.parquet", **options})
    return load(spark, config, df=df).df


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*KEYS_NAMES)


# Sources, filters, selections


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def filter_equal(spark, sf_dir):
    return plain(selections(spark, sf_dir, "lineitem", filters=[{"column": "l_returnflag", "values": ["R"]}])).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def filter_in(spark, sf_dir):
    return plain(selections(spark, sf_dir, "lineitem", filters=[{"column": "l_returnflag", "values": ["A", "R"]}])).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 4)")
def filter_in_numbers(spark, sf_dir):
    return plain(selections(spark, sf_dir, "lineitem", filters=[{"column": "l_linenumber", "values": [2, 4]}])).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?' OR p_brand GLOB '*5'")
def filter_wildcard(spark, sf_dir):
    return plain(selections(spark, sf_dir, "part", filters=[{"column": "p_brand", "values": ["Brand#[1-3]?", "*5"]}])).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority GLOB '[12]*'")
def filter_and(spark, sf_dir):
    filters = [{"column": "o_orderstatus", "values": ["F", "O"]}, {"column": "o_orderpriority", "values": ["[12]*"]}]
    return plain(selections(spark, sf_dir, "orders", filters=filters)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT 'orders_' || o_orderstatus AS selection, count(*) AS n FROM orders GROUP BY o_orderstatus")
def split_selection_counts(spark, sf_dir):
    return selections(spark, sf_dir, "orders", split={"by": "o_orderstatus"}).groupBy("selection").agg(F.count("*").alias("n"))


@query("SELECT 'documents_' || source AS selection, count(*) AS n FROM documents WHERE source GLOB 'src1*' AND NOT source GLOB 'src1[0-4]' AND source <> 'src19' GROUP BY source")
def split_exclude(spark, sf_dir):
    return selections(spark, sf_dir, "documents", split={"by": "source", "values": ["src1*"], "exclude": ["src1[0-4]", "src19"]}).groupBy("selection").agg(F.count("*").alias("n"))


@query("SELECT 'lineitem_' || l_linenumber AS selection, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def split_number(spark, sf_dir):
    return selections(spark, sf_dir, "lineitem", split={"by": "l_linenumber"}).groupBy("selection").agg(F.count("*").alias("n"))


@query("SELECT 'orders_F' AS selection, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def split_replaces_filter(spark, sf_dir):
    return selections(spark, sf_dir, "orders", filters=[{"column": "o_orderstatus", "values": ["O"]}], split={"by": "o_orderstatus", "values": ["F"]}).groupBy("selection").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size_string, CAST(p_size AS DOUBLE) AS p_size_float64, CAST(p_partkey AS INTEGER) AS p_partkey_int32 FROM part")
def cast_transform(spark, sf_dir):
    casts = [{"column": "p_size", "to_type": "string"}, {"column": "p_size", "to_type": "float64"}, {"column": "p_partkey", "to_type": "int32"}, {"column": "absent", "to_type": "bool"}]
    return plain(selections(spark, sf_dir, "part", transform=casts)).select("p_partkey", "p_size_string", "p_size_float64", "p_partkey_int32")


@query("SELECT doc_id, '/data/corpus/' || source AS source FROM documents")
def sample_path(spark, sf_dir):
    return plain(selections(spark, sf_dir, "documents", sample_path=[{"column": "source", "prefix": "/data/corpus/"}])).select("doc_id", "source")


# Completeness


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem holds no null, so some values are taken out."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.withColumns({"l_quantity": F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), "l_discount": F.when(F.col("l_discount") > 0.015, F.col("l_discount")).otherwise(F.lit(float("nan"))), "l_linestatus": F.when(F.col("l_linenumber") != 3, F.col("l_linestatus"))})


_GAPS = """WITH t AS (SELECT l_returnflag, l_tax, CASE WHEN l_quantity <= 45 THEN l_quantity END AS q, CASE WHEN l_discount > 0.015 THEN l_discount END AS d,
    CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS s FROM lineitem),
    c AS (SELECT {key} AS selection, count(q) / count(*) AS q, count(d) / count(*) AS d, count(s) / count(*) AS s, count(l_tax) / count(*) AS x FROM t GROUP BY 1)
    SELECT selection, round(q, 6) AS completeness_l_quantity, round(d, 6) AS completeness_l_discount, round(s, 6) AS completeness_l_linestatus,
    round(x, 6) AS completeness_l_tax, round((q + d + s + x) / 4, 6) AS completeness_overall FROM c"""
_GAP_COLUMNS = ["l_quantity", "l_discount", "l_linestatus", "l_tax"]


@query(_GAPS.format(key="'lineitem'"))
def completeness_global(spark, sf_dir):
    p = Completeness({"name": "c", "columns": {"input": _GAP_COLUMNS}})
    return rounded(metrics_table(p.compute(selections(spark, sf_dir, "lineitem", with_nulls(spark, sf_dir)))))


@query(_GAPS.format(key="'lineitem_' || l_returnflag"))
def completeness_by_split(spark, sf_dir):
    p = Completeness({"name": "c", "columns": {"input": _GAP_COLUMNS}})
    return rounded(metrics_table(p.compute(selections(spark, sf_dir, "lineitem", with_nulls(spark, sf_dir), split={"by": "l_returnflag"}))))


@query("SELECT 'documents' AS selection, round((count(quality) / count(*) + count(toxic) / count(*) + count(text) / count(*)) / 3, 6) AS completeness_overall FROM documents LEFT JOIN labels USING (doc_id)")
def completeness_overall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    p = Completeness({"name": "c", "columns": {"input": ["quality", "toxic", "text"]}, "include_per_column": False})
    return rounded(metrics_table(p.compute(selections(spark, sf_dir, "documents", df))))


# Diversity

_SQL_MEASURES = {
    "simpson": "CASE WHEN sum(n) > 1 THEN 1 - sum(CAST(n AS DOUBLE) * (n - 1)) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)) ELSE 0 END",
    "gini": "1 - sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n))",
    "shannon": "ln(sum(n)) - sum(n * ln(n)) / sum(n)",
    "richness": "count(*)",
}


def _diversity_sql(table: str, columns: list[str], measures: list[str], split: str | None = None) -> str:
    key = f"'{table}_' || {split}" if split else f"'{table}'"
    parts = []
    for c in columns:
        values = ", ".join(f"{_SQL_MEASURES[m] if m == 'richness' else f'round({_SQL_MEASURES[m]}, 6)'} AS {c}_{m}" for m in measures)
        parts.append(f"(SELECT selection, {values} FROM (SELECT {key} AS selection, {c}, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY selection)")
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (selection)" for p in parts[1:])


def _diversity(spark: SparkSession, sf_dir: str, table: str, columns: list[str], measures: list[str], **options) -> DataFrame:
    p = Diversity({"name": "d", "columns": {"input": columns}, "metrics": measures})
    return rounded(metrics_table(p.compute(selections(spark, sf_dir, table, **options))))


@query(_diversity_sql("orders", ["o_orderpriority", "o_orderstatus"], ["simpson"]))
def diversity_simpson(spark, sf_dir):
    return _diversity(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"], ["simpson"])


@query(_diversity_sql("orders", ["o_orderpriority", "o_orderstatus"], ["gini"]))
def diversity_gini(spark, sf_dir):
    return _diversity(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"], ["gini"])


@query(_diversity_sql("events", ["event_type", "user_id"], ["shannon"]))
def diversity_shannon(spark, sf_dir):
    return _diversity(spark, sf_dir, "events", ["event_type", "user_id"], ["shannon"])


@query(_diversity_sql("part", ["p_brand", "p_type", "p_size"], ["richness"]))
def diversity_richness(spark, sf_dir):
    return _diversity(spark, sf_dir, "part", ["p_brand", "p_type", "p_size"], ["richness"])


@query(_diversity_sql("documents", ["source", "n_chars"], ["simpson", "gini", "shannon", "richness"], "lang"))
def diversity_all_by_split(spark, sf_dir):
    return _diversity(spark, sf_dir, "documents", ["source", "n_chars"], ["simpson", "gini", "shannon", "richness"], split={"by": "lang"})


@query(
    "WITH c AS (SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality) SELECT 'documents' AS selection, "
    + ", ".join(f"{v if k == 'richness' else f'round({v}, 6)'} AS quality_{k}" for k, v in _SQL_MEASURES.items())
    + " FROM c"
)
def diversity_null_category(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return _diversity(spark, sf_dir, "documents", ["quality"], ["simpson", "gini", "shannon", "richness"], df=df)


# Representativeness: parameters are given, so bins are literals in SQL

_NORMAL = {"mean": 25.0, "std": 14.0}
_UNIFORM = {"min": 1.0, "max": 50.0}


def _rep(distribution: str, metrics: list[str], **options) -> Representativeness:
    given = {"column": "l_quantity", **(_NORMAL if distribution == "normal" else _UNIFORM)}
    return Representativeness({"name": "r", "columns": {"input": ["l_quantity"]}, "distribution": distribution, "metrics": metrics, "mean_std_estimation": "user_provided", "distribution_params": [given], "include_metadata": False, **options})


def _edges(distribution: str) -> list[float]:
    return [stats.normal_quantile(i / 10, **_NORMAL) for i in range(1, 10)] if distribution == "normal" else [1 + 4.9 * i for i in range(1, 10)]


def _bin_sql(distribution: str, key: str = "l_returnflag") -> str:
    inside = "" if distribution == "normal" else " WHERE l_quantity BETWEEN 1 AND 50"
    place = " + ".join(f"CAST(l_quantity >= {e!r}::DOUBLE AS INTEGER)" for e in _edges(distribution))
    return f"SELECT 'lineitem_' || {key} AS selection, {place} AS bin, count(*) AS n FROM lineitem{inside} GROUP BY ALL"


def _histogram(spark: SparkSession, sf_dir: str, distribution: str) -> DataFrame:
    p = _rep(distribution, ["grte"])
    df = selections(spark, sf_dir, "lineitem", split={"by": "l_returnflag"})
    from tallyforge.operators.representativeness import edges_of

    params, counted = p.parameters(df)
    edges = {k: edges_of(distribution, 10, v, counted[k]["min"], counted[k]["max"], 1e-9) for k, v in params.items()}
    rows = [(s, b, int(n)) for (s, _), counts in p.histograms(df, edges).items() for b, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "selection string, bin int, n long")


@query(_bin_sql("normal"))
def rep_hist_normal(spark, sf_dir):
    return _histogram(spark, sf_dir, "normal")


@query(_bin_sql("uniform"))
def rep_hist_uniform(spark, sf_dir):
    return _histogram(spark, sf_dir, "uniform")


def _metric(spark: SparkSession, sf_dir: str, distribution: str, metric: str, keep: dict[str, str], **options) -> DataFrame:
    out = _rep(distribution, [metric], **options).compute(selections(spark, sf_dir, "lineitem", split={"by": "l_returnflag"}))
    return rounded(out.select("selection", *(F.col(f"`l_quantity_{metric}_{k}`").alias(v) for k, v in keep.items())))


@query(f"WITH b AS ({_bin_sql('uniform')}), t AS (SELECT selection, sum(n) AS t FROM b GROUP BY 1) SELECT selection, round(sum((n - t / 10) * (n - t / 10) / (t / 10)), 6) AS statistic FROM b JOIN t USING (selection) GROUP BY 1")
def rep_chi2(spark, sf_dir):
    return _metric(spark, sf_dir, "uniform", "chi-square", {"statistic": "statistic"})


@query(f"WITH b AS ({_bin_sql('normal')}) SELECT selection, round(exp(-2 * abs(ln(10) - (ln(sum(n)) - sum(n * ln(n)) / sum(n)))), 6) AS grte, CASE WHEN exp(-2 * abs(ln(10) - (ln(sum(n)) - sum(n * ln(n)) / sum(n)))) > 0.5 THEN 'representative' ELSE 'under-represented' END AS label FROM b GROUP BY 1")
def rep_grte(spark, sf_dir):
    return _metric(spark, sf_dir, "normal", "grte", {"grte_value": "grte", "interpretation": "label"}, interpretation={})


@query("SELECT DISTINCT 'lineitem_' || l_returnflag AS selection, round(ln(10), 6) AS entropy, 'high_diversity' AS label FROM lineitem")
def rep_shannon(spark, sf_dir):
    return _metric(spark, sf_dir, "normal", "shannon-entropy", {"entropy": "entropy", "interpretation": "label"})


@query(
    """WITH c AS (SELECT 'lineitem_' || l_returnflag AS selection, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY ALL),
    r AS (SELECT *, sum(k) OVER (PARTITION BY selection ORDER BY v) AS a, sum(k) OVER (PARTITION BY selection) AS n, greatest(0, least(1, (v - 1) / 49)) AS f FROM c)
    SELECT selection, round(max(greatest(a / n - f, f - (a - k) / n)), 6) AS statistic, CAST(max(n) AS BIGINT) AS sample_size FROM r GROUP BY 1"""
)
def rep_ks_uniform(spark, sf_dir):
    return _metric(spark, sf_dir, "uniform", "kolmogorov-smirnov", {"statistic": "statistic", "sample_size": "sample_size"})


#: The normal distribution's integral by the series x + x^3 / 3 + x^5 / (3 * 5) + ..., for arguments of a few units.
_PHI = "CASE WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) END"


@query(
    f"""WITH c AS (SELECT 'lineitem_' || l_returnflag AS selection, (l_quantity - 25) / 14 AS z, count(*) AS k FROM lineitem GROUP BY ALL),
    r AS (SELECT *, sum(k) OVER (PARTITION BY selection ORDER BY z) AS a, sum(k) OVER (PARTITION BY selection) AS n, {_PHI} AS f FROM c),
    d AS (SELECT selection, max(greatest(a / n - f, f - (a - k) / n)) AS d, max(n) AS n FROM r GROUP BY 1)
    SELECT selection, round(d, 6) AS statistic, round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (-1) ** (k - 1) * exp(-2 * k * k * n * d * d))))), 6) AS p_value FROM d"""
)
def rep_ks_normal(spark, sf_dir):
    return _metric(spark, sf_dir, "normal", "kolmogorov-smirnov", {"statistic": "statistic", "p_value": "p_value"})


@query(
    "SELECT 'orders_' || o_orderstatus AS selection, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders GROUP BY 1"
)
def rep_parameters_all_data(spark, sf_dir):
    p = Representativeness({"name": "r", "columns": {"input": ["o_totalprice"]}, "mean_std_estimation": "from_all_data"})
    params, _ = p.parameters(selections(spark, sf_dir, "orders", split={"by": "o_orderstatus"}))
    rows = [(s, *(round(v[k], 4) for k in ("mean", "std", "min", "max"))) for (s, _), v in params.items()]
    return spark.createDataFrame(rows, "selection string, mean double, std double, low double, high double")


@query()
def rep_first_batch_all_metrics(spark, sf_dir):
    p = Representativeness({"name": "r", "columns": {"input": ["value"]}})
    return rounded(metrics_table(p.compute(selections(spark, sf_dir, "events"), 10_000, "event_id")))


@query("WITH f AS (SELECT * FROM events ORDER BY event_id LIMIT 2000) SELECT 'events' AS selection, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM f")
def rep_first_batch_parameters(spark, sf_dir):
    p = Representativeness({"name": "r", "columns": {"input": ["value"]}, "mean_std_estimation": "from_first_batch"})
    return _parameters(spark, p.parameters(selections(spark, sf_dir, "events"), 2000, "event_id")[0])


@query("SELECT 'orders_' || o_orderstatus AS selection, 100000.0::DOUBLE AS mean, round(stddev_pop(o_totalprice), 6) AS std, 0.0::DOUBLE AS low, round(max(o_totalprice), 6) AS high FROM orders GROUP BY 1")
def rep_given_in_part(spark, sf_dir):
    """What isn't given comes from the values."""
    given = [{"column": "o_totalprice", "mean": 100_000.0, "min": 0.0}]
    p = Representativeness({"name": "r", "columns": {"input": ["o_totalprice"]}, "mean_std_estimation": "from_all_data", "distribution_params": given})
    return _parameters(spark, p.parameters(selections(spark, sf_dir, "orders", split={"by": "o_orderstatus"}))[0])


@query(
    """WITH t AS (SELECT l_quantity AS q, l_linenumber AS i FROM lineitem WHERE l_linenumber > 2)
    SELECT 'lineitem' AS selection, count(*) AS n, round(avg(q) FILTER (WHERE i > 3), 6) AS mean, round(stddev_pop(q) FILTER (WHERE i > 3), 6) AS std FROM t"""
)
def rep_text_nan_infinity(spark, sf_dir):
    """Text that is no number and NaN count as nothing, infinities as values, though not in means."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = F.when(F.col("l_linenumber") == 1, "none").when(F.col("l_linenumber") == 2, "NaN").when(F.col("l_linenumber") == 3, "Infinity").otherwise(F.col("l_quantity").cast("string"))
    p = Representativeness({"name": "r", "columns": {"input": ["odd"]}, "mean_std_estimation": "from_all_data"})
    params, counted = p.parameters(selections(spark, sf_dir, "lineitem", df.select(odd.alias("odd"))))
    rows = [(s, int(counted[s, c]["n"]), round(v["mean"], 6), round(v["std"], 6)) for (s, c), v in params.items()]
    return spark.createDataFrame(rows, "selection string, n long, mean double, std double")


def _parameters(spark: SparkSession, params: dict) -> DataFrame:
    rows = [(s, *(round(v[k], 6) for k in ("mean", "std", "min", "max"))) for (s, _), v in params.items()]
    return spark.createDataFrame(rows, "selection string, mean double, std double, low double, high double")


# Distances between labels of the embeddings

_E = "WITH e AS (SELECT 'embeddings_' || label AS s, label AS ix, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"
_X = " x AS (SELECT s, ix, vec_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e),"
_ORDER = "a.ix < b.ix"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections in the order of their labels as text, which for one digit is that of the numbers."""
    return selections(spark, sf_dir, "embeddings", split={"by": "label"})


def distance(metric: str, **options) -> gap.DomainGap:
    columns = options.pop("columns", {"input": ["embedding"]})
    return gap.DomainGap({"name": "g", "columns": columns, "distance": {"metric": metric, **options.pop("distance", {})}, **options})


def _gap(spark: SparkSession, sf_dir: str, metric: str, **options) -> DataFrame:
    return rounded(distance(metric, **options).compute(labelled(spark, sf_dir)).select("selection_source", "selection_target", F.col(metric).alias("value")))


@query(_E + _X.rstrip(",") + " SELECT s AS selection, pos, count(*) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS ss FROM x GROUP BY s, pos")
def gap_moments(spark, sf_dir):
    m = gap.moments(gap.vectors(labelled(spark, sf_dir), "embedding")).withColumn("pos", F.col("pos").cast("long"))
    return rounded(m.drop("selection_ix"))


_MEANS = " m AS (SELECT s, ix, pos, avg(x) AS m, greatest(1e-9, avg(x * x) - avg(x) * avg(x)) AS v FROM x GROUP BY s, ix, pos)"


@query(_E + _X + _MEANS + f" SELECT a.s AS selection_source, b.s AS selection_target, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS value FROM m a JOIN m b ON a.pos = b.pos AND {_ORDER} GROUP BY 1, 2")
def gap_mmd_linear(spark, sf_dir):
    return _gap(spark, sf_dir, "mmd_linear")


@query(_E + _X + _MEANS + f" SELECT a.s AS selection_source, b.s AS selection_target, round(sum(a.v / b.v - 1 - ln(a.v / b.v) + (b.m - a.m) * (b.m - a.m) / b.v) / 2, 6) AS value FROM m a JOIN m b ON a.pos = b.pos AND {_ORDER} GROUP BY 1, 2")
def gap_klmvn(spark, sf_dir):
    return _gap(spark, sf_dir, "klmvn_diag")


@query(
    _E + _X + _MEANS + ", p AS (SELECT a.s AS x, b.s AS y, a.pos, a.m AS am, b.m AS bm, a.v AS av, b.v AS bv, 0.1 * (avg(a.v) OVER (PARTITION BY a.s, b.s) + avg(b.v) OVER (PARTITION BY a.s, b.s)) / 2 AS e"
    f" FROM m a JOIN m b ON a.pos = b.pos AND {_ORDER}) SELECT x AS selection_source, y AS selection_target, round(sum((av + e) / (bv + e) - 1 - ln((av + e) / (bv + e)) + (bm - am) * (bm - am) / (bv + e)) / 2, 6) AS value FROM p GROUP BY 1, 2"
)
def gap_klmvn_eps(spark, sf_dir):
    return _gap(spark, sf_dir, "klmvn_diag", distance={"klmvn_var_eps": 0.1})


@query(_E + _X + _MEANS + f" SELECT a.s AS selection_source, b.s AS selection_target, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS value FROM m a JOIN m b ON a.pos = b.pos AND {_ORDER} GROUP BY 1, 2")
def gap_wildcard_column(spark, sf_dir):
    p = distance("mmd_linear", columns={"input": ["emb*"]})
    return rounded(p.compute(labelled(spark, sf_dir)).select("selection_source", "selection_target", F.col("mmd_linear").alias("value")))


@query(
    _E + _X + " x2 AS (SELECT *, label FROM (SELECT *, CASE WHEN ix < 5 THEN 'low' ELSE 'high' END AS label FROM x)),"
    " m AS (SELECT label, pos, avg(x) AS m FROM x2 GROUP BY label, pos)"
    " SELECT 'low' AS selection_source, 'high' AS selection_target, 'mmd_linear' AS metric, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS mmd_linear, CAST(NULL AS VARCHAR) AS note FROM m a JOIN m b ON a.pos = b.pos AND a.label = 'low' AND b.label = 'high'"
)
def gap_between_tables(spark, sf_dir):
    """Two tables without a job."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = job.gap_between(spark, df.where("label < 5"), df.where("label >= 5"), distance("mmd_linear"), names=("low", "high"))
    return rounded(spark.createDataFrame([tuple(found.values())], "selection_source string, selection_target string, metric string, mmd_linear double, note string"))


@query(
    _E + _X + " h AS (SELECT s, ix, pos, least(31, CAST(floor((x + 0.6) / (1.2 / 32)) AS INTEGER)) AS bin, count(*) AS n FROM x WHERE x BETWEEN -0.6 AND 0.6 GROUP BY ALL),"
    " g AS (SELECT s, ix, pos, unnest(range(32)) AS bin FROM (SELECT DISTINCT s, ix, pos FROM h)),"
    " c AS (SELECT s, ix, pos, bin, sum(coalesce(n, 0)) OVER (PARTITION BY s, pos ORDER BY bin) / sum(coalesce(n, 0)) OVER (PARTITION BY s, pos) AS c FROM g LEFT JOIN h USING (s, ix, pos, bin)),"
    f" d AS (SELECT a.s AS selection_source, b.s AS selection_target, pos, sum(abs(a.c - b.c)) * (1.2 / 32) AS d FROM c a JOIN c b USING (pos, bin) WHERE {_ORDER} GROUP BY 1, 2, 3)"
    " SELECT selection_source, selection_target, round(avg(d), 6) AS value FROM d GROUP BY 1, 2"
)
def gap_wasserstein(spark, sf_dir):
    return _gap(spark, sf_dir, "wasserstein_1d", summary={"histogram": {"range": [-0.6, 0.6]}})


def _kernel_sql(kernel: str) -> str:
    return (
        _E + f" k AS (SELECT a.s AS x, b.s AS y, a.ix AS i, b.ix AS j, avg({kernel}) AS k FROM e a JOIN e b ON a.ix <= b.ix GROUP BY ALL)"
        " SELECT a.x AS selection_source, b.x AS selection_target, round(greatest(0, a.k + b.k - 2 * k.k), 6) AS value FROM k JOIN k a ON a.i = k.i AND a.j = k.i JOIN k b ON b.i = k.j AND b.j = k.j WHERE k.i < k.j"
    )


@query(_kernel_sql("exp(-list_distance(a.v, b.v))"))
def gap_mmd_rbf(spark, sf_dir):
    return _gap(spark, sf_dir, "mmd_rbf")


@query(_kernel_sql("pow(list_inner_product(a.v, b.v) + 1, 3)"))
def gap_mmd_poly(spark, sf_dir):
    return _gap(spark, sf_dir, "mmd_poly")


def _cmd_sql(where: str = "true", channel: str = "pos", digits: int | None = None) -> str:
    means = ", ".join(f"avg(pow(1 / (1 + exp(-x)), {j})) AS m{j}" for j in range(1, 6))
    central = ["m1 AS c1"] + [" + ".join(f"{comb(j, i) * (-1) ** (j - i)} * {f'm{i}' if i else '1'} * pow(m1, {j - i})" for i in range(j + 1)) + f" AS c{j}" for j in range(2, 6)]
    total = " + ".join(f"sqrt(sum((a.c{j} - b.c{j}) * (a.c{j} - b.c{j})))" for j in range(1, 6))
    value = f"({total}) / 5" if digits is None else f"round(({total}) / 5, {digits})"
    return _E + _X + f" p AS (SELECT s, ix, {channel} AS pos, {means} FROM x WHERE {where} GROUP BY ALL), c AS (SELECT s, ix, pos, {', '.join(central)} FROM p) SELECT a.s AS selection_source, b.s AS selection_target, {value} AS value FROM c a JOIN c b ON a.pos = b.pos AND {_ORDER} GROUP BY 1, 2"


def _cmd_layers_sql() -> str:
    """Two layers: the first half of each vector as 32 channels, the second as 16 of two cells, three times as heavy."""
    one = _cmd_sql("pos < 32", "pos")
    two = _cmd_sql("pos >= 32", "(pos - 32) // 2")
    return f"WITH one AS ({one}), two AS ({two}) SELECT selection_source, selection_target, round((one.value + 3 * two.value) / 4, 6) AS value FROM one JOIN two USING (selection_source, selection_target)"


@query(_cmd_layers_sql())
def gap_cmd_layers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumns({"first": F.slice("embedding", 1, 32), "second": F.slice("embedding", 33, 32)})
    p = distance("cmd", columns={"input": ["first", "second"]}, distance={"feature_weights": [1.0, 3.0]}, summary={"channels": {"first": 32, "second": 16}})
    found = p.compute(selections(spark, sf_dir, "embeddings", df, split={"by": "label"}))
    return rounded(found.select("selection_source", "selection_target", F.col("cmd").alias("value")))


@query(_cmd_sql(digits=6))
def gap_cmd(spark, sf_dir):
    return _gap(spark, sf_dir, "cmd", summary={"channels": {"embedding": 64}})


@query()
def gap_fid(spark, sf_dir):
    return _gap(spark, sf_dir, "fid")


@query()
def gap_pad(spark, sf_dir):
    halves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("half", F.when(F.col("label") < 5, "low").otherwise("high"))
    p = distance("pad", distance={"evaluator": "mse"})
    return rounded(p.compute(selections(spark, sf_dir, "embeddings", halves, split={"by": "half"})).select("selection_source", "selection_target", F.col("pad").alias("value")), 4)


@query("SELECT 'embeddings_' || a.label AS selection_source, 'embeddings_' || b.label AS selection_target, 'nothing' AS metric, 'unsupported metric or invalid inputs' AS note, 'embeddings_' || a.label || '_embeddings_' || b.label AS source_target FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label")
def gap_notes(spark, sf_dir):
    return gap_table(distance("nothing").compute(labelled(spark, sf_dir)))


# Features


_PIXELS = """WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - list_min(CAST(embedding AS DOUBLE[]))) / (list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[])))) AS p FROM embeddings),
    x AS (SELECT vec_id, unnest(p) AS x, unnest(range(64)) AS i FROM p),
    b AS (SELECT a.vec_id, a.x, a.i, coalesce(u.x, 0) + coalesce(d.x, 0) + coalesce(l.x, 0) + coalesce(r.x, 0) - 4 * a.x AS y FROM x a LEFT JOIN x u ON u.vec_id = a.vec_id AND u.i = a.i - 8
      LEFT JOIN x d ON d.vec_id = a.vec_id AND d.i = a.i + 8 LEFT JOIN x l ON l.vec_id = a.vec_id AND l.i = a.i - 1 AND a.i % 8 > 0 LEFT JOIN x r ON r.vec_id = a.vec_id AND r.i = a.i + 1 AND a.i % 8 < 7),
    n AS (SELECT vec_id, least(255, floor(x * 256)) AS bin, count(*) / 64 AS q FROM x GROUP BY ALL)
    SELECT vec_id, round(avg(x), 6) AS luminosity, round(stddev_pop(x), 6) AS contrast, round(var_pop(y), 6) AS blur, (SELECT round(-sum(q * ln(q)), 6) FROM n WHERE n.vec_id = b.vec_id) AS entropy FROM b GROUP BY vec_id"""


@query(_PIXELS)
def visual_pixels(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(df.select("vec_id", *(v.alias(k) for k, v in images.pixel_features(F.col("embedding"), 8).items())))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a gray PNG of 8 x 8."""

    @F.pandas_udf("binary")
    def png(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import struct
        import zlib

        import numpy as np

        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        for part in parts:
            out = []
            for v in part:
                g = np.clip((np.asarray(v, float) + 0.6) / 1.2 * 255, 0, 255).astype(np.uint8).reshape(8, 8)
                raw = b"".join(b"\0" + row.tobytes() for row in g)
                out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
            yield pd.Series(out)

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", png("embedding").alias("image_bytes"))


def _png_sql(kernel: dict[tuple[int, int], int], clause: str = "") -> str:
    """Features of the bytes that ``pictures`` writes; a picture's numbers go through 32 bits, as the operator's do."""
    near = " + ".join(f"{k} * coalesce(list_extract(g, CASE WHEN i // 8 + {dy} BETWEEN 0 AND 7 AND i % 8 + {dx} BETWEEN 0 AND 7 THEN i + {8 * dy + dx} + 1 END), 0)" for (dy, dx), k in kernel.items())
    real = lambda v: f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 6)"
    return f"""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(least(255, greatest(0, (CAST(x AS DOUBLE) + 0.6) / 1.2 * 255))) AS DOUBLE)) AS p FROM embeddings {clause}),
    q AS (SELECT vec_id, label, list_transform(p, lambda x: CAST(CAST((x - list_min(p)) / (list_max(p) - list_min(p)) AS FLOAT) AS DOUBLE)) AS g FROM p),
    x AS (SELECT vec_id, label, g, unnest(g) AS x, unnest(range(64)) AS i FROM q),
    b AS (SELECT vec_id, label, x, {near} AS y FROM x),
    n AS (SELECT vec_id, least(255, floor(x * 256)) AS bin, count(*) / 64 AS q FROM x GROUP BY ALL)
    SELECT vec_id, label, {real("avg(x)")} AS image_bytes_luminosity, {real("stddev_pop(x)")} AS image_bytes_contrast, {real("var_pop(y)")} AS image_bytes_blur,
    (SELECT {real("-sum(q * ln(q))")} FROM n WHERE n.vec_id = b.vec_id) AS image_bytes_entropy FROM b GROUP BY vec_id, label"""


_CROSS = {(-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1, (0, 0): -4}
_DIAMOND = {(dy, dx): images.LAPLACIAN["5x5"][dy + 2, dx + 2].astype(int).item() for dy in range(-2, 3) for dx in range(-2, 3) if images.LAPLACIAN["5x5"][dy + 2, dx + 2]}


def _png_features(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    from tallyforge.operators.visual import ImageFeatures

    df = ImageFeatures({"name": "v", "columns": {"input": ["image_bytes"]}, **options}).add(pictures(spark, sf_dir)).drop("image_bytes")
    return rounded(df.select(*(F.col(c).cast("double").alias(c) if kind == "float" else F.col(c) for c, kind in df.dtypes)))


@query(_png_sql(_CROSS))
def visual_png(spark, sf_dir):
    return _png_features(spark, sf_dir)


@query(_png_sql(_DIAMOND))
def visual_wide_kernel(spark, sf_dir):
    return _png_features(spark, sf_dir, laplacian_kernel="5x5")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 3 = 0) AS failed FROM embeddings")
def visual_failures(spark, sf_dir):
    """Pictures that can't be read give NaN under a silent policy, and are counted."""
    from tallyforge.operators.visual import ImageFeatures

    broken = pictures(spark, sf_dir).withColumn("image_bytes", F.when(F.col("vec_id") % 3 == 0, F.lit("no picture").cast("binary")).otherwise(F.col("image_bytes")))
    quiet = C.ErrorsConfig(images=C.ImageErrorsConfig(on_decode_failure="silent_fail", on_unsupported_format="silent_fail"), max_failure_rate=1.0)
    p = ImageFeatures({"name": "v", "columns": {"input": ["image_bytes"]}}, quiet)
    bad, rows = p.failures(p.add(broken))
    return spark.createDataFrame([(rows, bad)], "rows long, failed long")


@query()
def embedding_projection(spark, sf_dir):
    from tallyforge.operators.embedding import Embeddings

    p = Embeddings({"name": "e", "columns": {"input": ["image_bytes"]}, "model": {"arch": "projection"}, "infer": {"width": 8, "height": 8}})
    return p.add(pictures(spark, sf_dir)).drop("image_bytes")


# A whole job


def full_config(sf_dir: str) -> dict:
    return {
        "dataloaders": {"loaders": [{"name": "emb", "type": "parquet", "path": f"{sf_dir}/embeddings.parquet", "split": {"by": "label"}}]},
        "metrics": {
            "processors": [
                {"type": "completeness", "name": "c", "columns": {"input": ["vec_id", "label"]}},
                {"type": "diversity", "name": "d", "columns": {"input": ["label"]}},
                {"type": "representativeness", "name": "r", "columns": {"input": ["vec_id"]}, "distribution": "uniform", "mean_std_estimation": "from_all_data"},
            ]
        },
        "gap": {"processors": [{"type": "domain_gap", "name": "g", "columns": {"input": ["embedding"]}, "distance": {"metric": "mmd_linear"}}, {"type": "domain_gap", "name": "k", "columns": {"input": ["embedding"]}, "distance": {"metric": "klmvn_diag"}}]},
        "features": {"processors": []},
    }


@query()
def job_metrics(spark, sf_dir):
    return rounded(job.run(spark, full_config(sf_dir), write=False).metrics)


@query(
    _E.replace("embeddings_", "emb_") + _X + _MEANS + ", j AS (SELECT a.s AS selection_source, b.s AS selection_target, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS mmd,"
    f" round(sum(a.v / b.v - 1 - ln(a.v / b.v) + (b.m - a.m) * (b.m - a.m) / b.v) / 2, 6) AS kl FROM m a JOIN m b ON a.pos = b.pos AND {_ORDER} GROUP BY 1, 2),"
    " u AS (SELECT selection_source, selection_target, 'mmd_linear' AS metric, mmd AS mmd_linear, NULL AS klmvn_diag FROM j UNION ALL SELECT selection_source, selection_target, 'klmvn_diag', NULL, kl FROM j)"
    " SELECT *, CAST(NULL AS VARCHAR) AS note, selection_source || '_' || selection_target AS source_target FROM u"
)
def job_gap(spark, sf_dir):
    return rounded(job.run(spark, full_config(sf_dir), write=False).gap)


@query("SELECT vec_id, label, 'emb_' || label AS dataloader FROM embeddings WHERE label BETWEEN 0 AND 3")
def job_features(spark, sf_dir):
    df = selections(spark, sf_dir, "embeddings", split={"by": "label", "values": ["[0-3]"]}).withColumn("selection", F.concat(F.lit("emb_"), F.col("label")))
    return features_table(df, [c for c in df.columns if c not in KEYS_NAMES], [], None, ["embed*"])


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where the driver and all executors can write."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set")
        base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf_dir: str) -> job.JobResult:
    """A job over customers by market segment, written as Parquet."""
    where = folder(spark, "job")
    loader = {"name": "cust", "type": "parquet", "path": f"{sf_dir}/customer.parquet", "split": {"by": "c_mktsegment"}}
    metrics = [{"type": "diversity", "name": "d", "columns": {"input": ["c_nationkey"]}, "metrics": ["richness", "simpson"]}, {"type": "completeness", "name": "c", "columns": {"input": ["c_acctbal"]}}]
    return job.run(spark, {
        "dataloaders": {"loaders": [loader]},
        "metrics": {"processors": metrics, "outputs": {"path": f"{where}/metrics"}},
        "features": {"outputs": {"path": where + "/{}-{}", "include": ["c_cust*", "c_name"]}},
    })


@query(
    f"WITH n AS (SELECT 'cust_' || c_mktsegment AS selection, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT selection, {_SQL_MEASURES['richness']} AS c_nationkey_richness,"
    f" round({_SQL_MEASURES['simpson']}, 6) AS c_nationkey_simpson, 1.0::DOUBLE AS completeness_c_acctbal, 1.0::DOUBLE AS completeness_overall FROM n GROUP BY selection"
)
def sink_metrics(spark, sf_dir):
    """Read back from the files."""
    df = rounded(spark.read.parquet(_customers(spark, sf_dir).paths["metrics"]))
    return df.select(*(c for c in df.columns if not c.startswith("_metadata")))


@query("SELECT c_custkey, c_name, 'cust_' || c_mktsegment AS dataloader FROM customer")
def sink_features(spark, sf_dir):
    return spark.read.parquet(_customers(spark, sf_dir).paths["features"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def csv_source(spark, sf_dir):
    path = folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.csv(path, header=True)
    config = {"name": "nation", "type": "csv", "path": path, "filters": [{"column": "n_regionkey", "values": [2]}]}
    return plain(load(spark, C.DataLoaderConfig.model_validate(config)).df)


@query(
    "SELECT 'n' AS selection, 1.0::DOUBLE AS completeness_n_name, 0.0::DOUBLE AS completeness_r_name, 0.5::DOUBLE AS completeness_overall UNION ALL SELECT 'r', 0.0, 1.0, 0.5"
)
def job_two_loaders(spark, sf_dir):
    """A column that only one table has is empty in the other."""
    loaders = [{"name": t[0], "type": "parquet", "path": f"{sf_dir}/{t}.parquet"} for t in ("nation", "region")]
    config = {"dataloaders": {"loaders": loaders}, "metrics": {"processors": [{"type": "completeness", "name": "c", "columns": {"input": ["n_name", "r_name"]}}]}}
    df = rounded(job.run(spark, config, write=False).metrics)
    return df.select(*(c for c in df.columns if not c.startswith("_metadata")))


@query(
    f"WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), g AS ({_GAPS.format(key="'lineitem'")})"
    f" SELECT completeness_l_quantity, completeness_overall, (SELECT {_SQL_MEASURES['richness']} FROM n) AS l_returnflag_richness, (SELECT round({_SQL_MEASURES['shannon']}, 6) FROM n) AS l_returnflag_shannon FROM g"
)
def profile_table(spark, sf_dir):
    """All metrics of one table, without a job."""
    processors = [Completeness({"name": "c", "columns": {"input": _GAP_COLUMNS}}), Diversity({"name": "d", "columns": {"input": ["l_returnflag"]}, "metrics": ["richness", "shannon"]})]
    found = job.profile(spark, with_nulls(spark, sf_dir), processors)
    keys = ("completeness_l_quantity", "completeness_overall", "l_returnflag_richness", "l_returnflag_shannon")
    return rounded(spark.createDataFrame([tuple(found[k] for k in keys)], "completeness_l_quantity double, completeness_overall double, l_returnflag_richness long, l_returnflag_shannon double"))


@query(
    "SELECT 'lineitem_' || l_returnflag AS selection, count(*) AS total_samples, round(count(CASE WHEN l_quantity <= 45 THEN 1 END) / count(*), 6) AS l_quantity_score FROM lineitem GROUP BY 1"
)
def completeness_metadata(spark, sf_dir):
    p = Completeness({"name": "c", "columns": {"input": ["l_quantity"]}, "include_metadata": True})
    df = p.compute(selections(spark, sf_dir, "lineitem", with_nulls(spark, sf_dir), split={"by": "l_returnflag"}))
    part = lambda path: F.get_json_object("_metadata_c", path)
    return df.select("selection", part("$.total_samples_per_column").cast("long").alias("total_samples"), F.round(part("$.per_column_scores.l_quantity").cast("double"), 6).alias("l_quantity_score"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS rows, round(count(value) / count(*), 6) AS completeness_value, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY ALL")
def monitor_events(spark, sf_dir):
    from tallyforge.streaming.monitor import monitor

    out = monitor(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["value"], window="1 day", by=["event_type"])
    return rounded(out.drop("window_end", "value_about_distinct"))
