"""Learned entries: datasets, an ensemble of boosted trees, threshold choice and a meta filter, with pyspark.ml."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import crossing, forward_return


@dataclass(frozen=True)
class LearnConfig:
    horizon: int = 12
    z_grid: tuple[float, ...] = (1.5, 2.0, 2.5)
    cost_grid: tuple[float, ...] = (0.5, 1.0, 2.0)
    val_fraction: float = 0.3
    penalty: float = 1.0
    meta_least: float = 0.5
    ensemble: int = 3
    min_rows: int = 2000
    clip: float = 10.0
    rounds: int = 100
    depth: int = 3
    rate: float = 0.05


def finite_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return rows.where(fine)


def dataset(features: DataFrame, cfg: LearnConfig) -> DataFrame:
    """features with y (the scaled forward return, a target only) and scale (volatility over the horizon, causal)."""
    rows = features.withColumn("scale", F.col("spread_vol_24h") * cfg.horizon**0.5)
    return rows.withColumn("y", F.try_divide(forward_return("spread", "beta", ["pair"], "ts_ms", cfg.horizon), F.col("scale")))


def fit_slice(rows: DataFrame, start_ms: int, end_ms: int, horizon_ms: int, cfg: LearnConfig) -> DataFrame:
    """Training rows whose target ends before end_ms, with the target clipped."""
    own = rows.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms - horizon_ms) & F.col("y").isNotNull())
    return own.withColumn("y", F.greatest(F.lit(-cfg.clip), F.least(F.lit(cfg.clip), F.col("y"))))


def fit_ensemble(rows: DataFrame, columns: list[str], seed: int, cfg: LearnConfig) -> list[PipelineModel] | None:
    """Boosted trees with different seeds; None with too few rows."""
    own = finite_rows(rows, [*columns, "y"])
    if own.limit(cfg.min_rows).count() < cfg.min_rows:
        return None
    vector = VectorAssembler(inputCols=columns, outputCol="x")
    models = []
    for k in range(cfg.ensemble):
        trees = GBTRegressor(featuresCol="x", labelCol="y", predictionCol=f"p{k}", maxIter=cfg.rounds, maxDepth=cfg.depth, stepSize=cfg.rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=50, seed=100 * seed + k)
        models.append(Pipeline(stages=[vector, trees]).fit(own))
    return models


def predict(rows: DataFrame, models: list[PipelineModel], columns: list[str]) -> DataFrame:
    """rows with pred_ret and unc, the mean and deviation of the ensemble in units of return; NULL where a feature is missing."""
    out = finite_rows(rows, [*columns, "scale"])
    for m in models:
        out = m.transform(out).drop("x")
    names = [f"p{k}" for k in range(len(models))]
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    spread = F.sqrt(sum(((F.col(n) - mean) * (F.col(n) - mean) for n in names[1:]), (F.col(names[0]) - mean) * (F.col(names[0]) - mean)) / len(names))
    scored = out.select("pair", "ts_ms", (mean * F.col("scale")).alias("pred_ret"), (spread * F.col("scale")).alias("unc"))
    return rows.join(scored, ["pair", "ts_ms"], "left")


def entry_with_edge(z: str, level: float, need: float | Column, penalty: float) -> Column:
    """A fresh cross whose predicted return, less a penalty for doubt, exceeds what is needed."""
    side = crossing(z, ["pair"], "ts_ms", level)
    edge = side * F.col("pred_ret") - penalty * F.col("unc")
    return F.when((side != 0) & (edge > need), side).otherwise(0)


def best_cell(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first best of the grid; sits is true if even that doesn't win. scores: (keys, grid_idx, n, score)."""
    own = scores.withColumn("score", F.when(F.col("n") < 10, float("-inf")).otherwise(F.col("score")))
    rank = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("score"), "grid_idx"))  # a row for each cell
    return own.withColumn("_k", rank).where("_k = 1").drop("_k").withColumn("sits", ~(F.col("score") > 0))


def grid(spark, cfg: LearnConfig) -> DataFrame:
    """(grid_idx, entry_z, cost_mult): as many trials as cells."""
    cells = [(k, z, c) for k, (z, c) in enumerate((z, c) for z in cfg.z_grid for c in cfg.cost_grid)]
    return spark.createDataFrame(cells, "grid_idx int, entry_z double, cost_mult double")


def fit_meta(trades: DataFrame, columns: list[str], least: int = 30, c: float = 0.5) -> PipelineModel | None:
    """Whether a trade wins, from its candidate columns; None with few trades or one class."""
    own = finite_rows(trades.withColumn("won", (F.col("net_ret") > 0).cast("double")), columns)
    n, wins = own.agg(F.count("*"), F.sum("won")).first()
    if n < least or n != trades.count() or wins in (0, n):
        return None
    stages = [
        VectorAssembler(inputCols=columns, outputCol="m_raw"),
        StandardScaler(inputCol="m_raw", outputCol="m_x", withMean=True),
        LogisticRegression(featuresCol="m_x", labelCol="won", probabilityCol="m_prob", rawPredictionCol="m_rawp", predictionCol="m_pred", regParam=1 / (c * n), standardization=False),
    ]
    return Pipeline(stages=stages).fit(own)


def accept_meta(trades: DataFrame, model: PipelineModel | None, columns: list[str], least: float = 0.5) -> DataFrame:
    """trades with meta_ok; a trade with a missing input is not taken, without a model all are."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return trades.withColumn("meta_ok", F.lit(True))
    keyed = trades.withColumn("_id", F.xxhash64(*[F.col(k) for k in ("pair", "entry_ts", "side")]))
    scored = model.transform(finite_rows(keyed, columns)).select("_id", (vector_to_array("m_prob")[1] >= least).alias("meta_ok"))
    return keyed.join(scored.distinct(), "_id", "left").withColumn("meta_ok", F.coalesce("meta_ok", F.lit(False))).drop("_id")


def save_bundle(models: list[PipelineModel], meta: dict, path: str) -> None:
    """Models and a description with a version and the models' checksums, one line of text in a folder of its own."""
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model-{k}")
    spark = SparkSession.active()
    meta = meta | {"version": 1, "n_models": len(models), "digests": model_digests(spark, path)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def model_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of the data files of each model, by their place in the bundle; a bundle has a few."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{path}/model-*")
    name = F.regexp_extract("path", r"(model-[0-9]+/.*)$", 1)
    return {r.name: r.digest for r in files.select(name.alias("name"), F.sha2("content", 256).alias("digest")).orderBy("name").collect()}


def load_bundle(spark, path: str) -> tuple[list[PipelineModel], dict]:
    """The models and the description; a bundle that is incomplete or whose files have changed is refused."""
    meta = json.loads(spark.read.text(f"{path}/bundle").first().value)
    if meta.get("version") != 1 or not meta.get("pairs") or not meta.get("n_models"):
        raise ValueError("not a complete bundle of version 1")
    if model_digests(spark, path) != meta.get("digests"):
        raise ValueError("the bundle's models are not those that were saved")
    return [PipelineModel.load(f"{path}/model-{k}") for k in range(meta["n_models"])], meta


def allows_entries(meta: dict, now_ms: int) -> bool:
    """A bundle past its validity closes positions but opens none."""
    return now_ms < int(meta.get("valid_until_ms", 0))
