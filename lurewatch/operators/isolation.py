"""Isolation forest.

Every tree is grown from a uniform sample of a few hundred rows, so training needs one pass that
picks the samples and one small group per tree.  The grown forest is a bounded table (trees times
twice the sample size); scoring applies it to Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.scores import sigmoid
from lurewatch.session import stage

SAMPLE_ROWS = 256  # fixed value
_OVERSAMPLE = 4
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left_child int, right_child int, "
    "path double"
)


def average_path(n: int | np.ndarray) -> float:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _bound(share: float) -> int:
    """The value below which that share of the positive 63-bit hashes lies."""
    return min(2**63 - 1, int(share * 2**63))


def tree_samples(
    features: DataFrame, id_col: str, n_rows: int, trees: int, sample_rows: int, seed: int
) -> DataFrame:
    """(tree, draw, values): for every tree the candidates of its sample.

    One hash per row thins the table to a pool of about ``trees * sample_rows`` rows.  A row of
    the pool is a candidate of every tree for which a second hash falls below a bound set so that
    about four times the sample size qualify; the tree keeps the smallest hashes, a uniform
    sample without replacement.  The same two steps hold at every size; a table smaller than the
    pool is its own pool.
    """
    positive = F.lit(2**63 - 1)
    pool = min(1.0, trees * sample_rows / n_rows)
    share = min(1.0, _OVERSAMPLE * sample_rows / (pool * n_rows))
    row = F.xxhash64(F.lit(seed + 1), F.col(id_col)).bitwiseAND(positive)
    pooled = features.filter(row <= F.lit(_bound(pool)))

    def draw(tree: Column) -> Column:
        return F.xxhash64(F.lit(seed), tree, F.col(id_col)).bitwiseAND(positive)

    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    own = F.filter(numbers, lambda t: draw(t) <= F.lit(_bound(share)))
    return pooled.withColumn("tree", F.explode(own)).select("tree", draw(F.col("tree")).alias("draw"), "values")


def _grow(values: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, threshold, left, right, path)."""
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(values)), 0)]
    next_node = 1
    while pending:
        node, rows, depth = pending.pop()
        subset = values[rows]
        low, high = subset.min(axis=0), subset.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(splittable):
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = subset[:, feature] <= threshold
        left, right = next_node, next_node + 1
        next_node += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        pending += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    """Grown trees and the outlier threshold on the raw score."""

    nodes: pd.DataFrame
    feature_cols: list[str]
    sample_rows: int
    threshold: float = 0.5

    def raw_score(
        self, df: DataFrame, output_col: str = "isolation_raw", skip: Column | None = None
    ) -> DataFrame:
        """Add ``2 ** (-mean path / expected path)``, in (0, 1], higher for outliers.

        A null feature counts as 0.  Rows for which ``skip`` holds get null; neither their
        features nor the trees are evaluated for them.
        """
        scorer = _scorer(self)
        vector = F.array(
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.feature_cols]
        )
        if skip is not None:
            vector = F.when(~F.coalesce(skip, F.lit(False)), vector)
        return df.withColumn(output_col, scorer(vector))

    def score(
        self, df: DataFrame, output_col: str = "isolation_score", skip: Column | None = None
    ) -> DataFrame:
        """Raw score squashed by a sigmoid, hence between 0.5 and 0.731."""
        raw = self.raw_score(df, "_isolation_raw", skip)
        return raw.withColumn(output_col, sigmoid(F.col("_isolation_raw"))).drop("_isolation_raw")

    def save(self, path: str, metrics: DataFrame | None = None) -> None:
        """Trees, feature list and threshold, and the metrics of the run if given."""
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        settings = json.dumps(
            {"feature_cols": self.feature_cols, "sample_rows": self.sample_rows, "threshold": self.threshold}
        )
        table = spark.createDataFrame([(settings,)], "value string")
        table.coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        if metrics is not None:
            metrics.write.mode("overwrite").json(f"{path}/metrics")


def load_forest(spark: SparkSession, path: str) -> IsolationForest:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    # At most trees * 2 * sample_rows rows.
    nodes = spark.read.parquet(f"{path}/trees").toPandas()
    return IsolationForest(nodes, **settings)


def _scorer(forest: IsolationForest):
    trees = [
        (
            t["feature"].to_numpy(),
            t["threshold"].to_numpy(),
            t["left_child"].to_numpy(),
            t["right_child"].to_numpy(),
            t["path"].to_numpy(),
        )
        for _, t in forest.nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    expected = average_path(forest.sample_rows)
    width = len(forest.feature_cols)

    @F.arrow_udf("double")
    def raw_scores(vectors: pa.Array) -> pa.Array:
        known = vectors.is_valid()
        x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, path in trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += path[at]
        mean = total / len(trees)
        raw = np.full(len(vectors), np.nan)
        valid = known.to_numpy(zero_copy_only=False)
        raw[valid] = np.power(2.0, -mean / expected) if expected > 0 else 1.0
        return pa.array(raw, mask=~valid)

    return raw_scores


def train_isolation_forest(
    df: DataFrame,
    feature_cols: Sequence[str],
    id_col: str,
    trees: int = 200,
    contamination: float | str = "auto",
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 42,
) -> IsolationForest:
    """Grow a forest on (benign) feature rows; ``id_col`` identifies a row.

    ``contamination='auto'`` puts the outlier threshold at 0.5; a fraction puts it at that
    quantile of the training scores.
    """
    feature_cols = list(feature_cols)
    features = df.select(
        id_col,
        F.array(
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols]
        ).alias("values"),
    )
    n_rows = features.count()
    if n_rows == 0:
        raise ValueError("no training rows")
    size = min(sample_rows, n_rows)
    max_depth = math.ceil(math.log2(max(size, 2)))

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        sample = group.nsmallest(size, "draw", keep="first")
        values = np.stack(sample["values"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        grown = pd.DataFrame(
            _grow(values, rng, max_depth),
            columns=["node", "feature", "threshold", "left_child", "right_child", "path"],
        )
        grown.insert(0, "tree", tree)
        return grown

    nodes = (
        tree_samples(features, id_col, n_rows, trees, size, seed)
        .groupBy("tree")
        .applyInPandas(grow, NODE_SCHEMA)
        .toPandas()  # at most trees * 2 * sample_rows rows
    )
    forest = IsolationForest(nodes, feature_cols, size)
    if contamination != "auto":
        # Scored once; the quantile makes several passes over the one column.
        scored = stage(forest.raw_score(df.select(*feature_cols)).select("isolation_raw"), "raw-scores")
        forest.threshold = exact_quantile(scored, "isolation_raw", 1.0 - float(contamination))
    return forest


def outlier_flag(raw_score: Column, threshold: float = 0.5) -> Column:
    """1 for outliers: the raw score exceeds the threshold."""
    return F.when(raw_score > threshold, 1).otherwise(0)


def exact_quantile(df: DataFrame, col: str, q: float, grid: int = 4096) -> float:
    """Quantile with linear interpolation of a column with values in [0, 1].

    Values are counted on a grid, and only the cell that holds the wanted rank is refined, until
    it is a single value or few enough values to look at.  Equal values are one row with a count.
    """
    n = df.filter(F.col(col).isNotNull()).count()
    if n == 0:
        raise ValueError("quantile of an empty column")
    position = q * (n - 1)
    low = int(math.floor(position))
    first = _order_statistic(df, col, low, grid)
    if position == low:
        return first
    second = _order_statistic(df, col, low + 1, grid)
    return first + (second - first) * (position - low)


def _order_statistic(df: DataFrame, col: str, rank: int, grid: int) -> float:
    """The value at 0-based ``rank``."""
    low, width = 0.0, 1.0
    subset = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    while True:
        cell = F.least(F.floor((F.col("v") - low) / (width / grid)), F.lit(grid - 1))
        counts = (
            subset.groupBy(cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("cell")
            .collect()  # at most ``grid`` rows
        )
        for row in counts:
            if rank < row["n"]:
                break
            rank -= row["n"]
        if row["lo"] == row["hi"]:
            return row["lo"]
        subset = subset.filter(F.col("v").between(row["lo"], row["hi"]))
        low, width = row["lo"], row["hi"] - row["lo"]
