"""Model operators: matrix, training, scoring, imputation, outliers, attribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from fintrail.functions import constants as K
from fintrail.functions.keyed import quantiles, running_totals
from fintrail.functions.numeric import rnd
from fintrail.operators import risk as R
from fintrail.operators.neighbours import knn_join
from fintrail.session import written

c = F.col


def feature_matrix(fv: DataFrame, key: str = "user_id", drop: list[str] | None = None) -> DataFrame:
    """The 40 model columns in fixed order as doubles; flags as 0/1, missing as 0."""
    zero = set(drop or ())
    col = lambda n: (F.lit(0.0) if n in zero or n not in fv.columns else
                     F.coalesce(c(n).cast("int").cast("double") if isinstance(fv.schema[n].dataType, T.BooleanType)
                                else c(n).cast("double"), F.lit(0.0)))
    return fv.select(key, *[col(n).alias(n) for n in K.FEATURE_COLUMNS])


def in_training(key: str = "user_id", share: float = 0.8):
    """Stable 80/20 split by key hash: a user stays on one side in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)


def train(fv: DataFrame, labels: DataFrame, drop: list[str] | None = None, max_iter: int = 300,
          key: str = "user_id") -> tuple[PipelineModel, float]:
    """Boosted trees on the matrix; (model, validation AUC). Stops early on the validation part."""
    data = feature_matrix(fv, key, drop).join(labels.select(key, c("label").cast("double").alias("label")), key)
    data = data.withColumn("held_out", ~in_training(key))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
                        maxIter=max_iter, seed=42, validationIndicatorCol="held_out")
    model = Pipeline(stages=[VectorAssembler(inputCols=K.FEATURE_COLUMNS, outputCol="features"), gbt]).fit(data)
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(data.where("held_out")))
    return model, auc


def score(fv: DataFrame, full: PipelineModel, income_heavy: PipelineModel, delta: DataFrame | None = None) -> DataFrame:
    """Credit decision per user: routed model, trajectory boost, terms and rule trace.

    delta(user_id, trajectory_delta) is optional.
    """
    def proba(model, drop):
        m = model.transform(feature_matrix(fv, drop=drop))
        return m.select("user_id", vector_to_array("probability")[1].alias("p"))
    a = proba(full, None).withColumnRenamed("p", "p_full")
    b = proba(income_heavy, K.DISCRETIONARY_COLUMNS).withColumnRenamed("p", "p_income")
    d = fv.join(a, "user_id").join(b, "user_id").withColumn("model", R.route(c("data_completeness_score")))
    d = d.withColumn("_p", F.when(c("model") == "income_heavy", c("p_income")).otherwise(c("p_full")))
    d = d.join(delta, "user_id", "left") if delta is not None else d.withColumn("trajectory_delta", F.lit(0.0))
    d = R.loan_terms(R.boosted(d.fillna(0.0, subset=["trajectory_delta"]), "_p", "trajectory_delta"))
    return d.withColumn("rule_trace", R.rule_trace()).drop("_p", "p_full", "p_income")


def auc(df: DataFrame, score_col: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks, ties counted half.

    Scores are summed per distinct value and accumulated bucket by bucket, so no
    task sorts the whole table.
    """
    lab = c(label).cast("long")
    t = running_totals(df.where(c(score_col).isNotNull()), [], score_col, {"pos": lab, "neg": 1 - lab})
    wins = F.sum(c("pos") * (c("neg_before") + c("neg") / 2.0))
    return t.agg(rnd(wins / (F.sum("pos") * F.sum("neg")), 6).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


# --------------------------------------------------------------- imputation

def nan_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the coordinates both rows have, scaled up for the missing ones."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    sq = (x * x) @ mb.T + ma @ (y * y).T - 2.0 * x @ y.T
    present = ma.astype(float) @ mb.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(present > 0, np.sqrt(np.maximum(sq, 0.0) * a.shape[1] / present), np.inf)


def knn_impute(df: DataFrame, reference: list[str], target: list[str], k: int = 5, key: str = "user_id") -> DataFrame:
    """Missing targets filled with the mean of the k nearest rows that have them.

    Reference columns must be present; the distance over them never exceeds the
    full distance, which is what the neighbour join prunes by. Targets missing on
    the same rows share one join.
    """
    marks = df.agg(*[F.count_if(c(t).isNull()).alias(t) for t in target],
                   *[F.count_if(c(a).isNull() != c(b).isNull()).alias(f"{a}|{b}") for i, a in enumerate(target) for b in target[i + 1:]]).first()
    groups: list[list[str]] = []
    for t in target:
        if marks[t] == 0:
            continue
        for g in groups:
            if marks[f"{g[0]}|{t}"] == 0:
                g.append(t)
                break
        else:
            groups.append([t])
    cols = reference + target
    full = F.array(*[F.coalesce(c(n).cast("double"), F.lit(float("nan"))) for n in cols])
    vec = df.select(c(key).alias("id"), F.array(*[c(n).cast("double") for n in reference]).alias("v"), full.alias("x"), *target)
    out = df
    for g in groups:
        q = vec.where(c(g[0]).isNull()).select(c("id").alias("q"), "v", "x")
        donors = vec.where(c(g[0]).isNotNull())
        near = knn_join(q, donors.select(c("id").alias("b"), "v", "x"), k, metric=nan_euclidean)
        fill = (near.join(donors.select(c("id").alias("b"), *g), "b").groupBy(c("q").alias(key))
                .agg(*[F.avg(n).alias(f"_f_{n}") for n in g]))
        out = out.join(fill, key, "left")
        for n in g:
            out = out.withColumn(n, F.coalesce(c(n), c(f"_f_{n}"))).drop(f"_f_{n}")
    return out


# ----------------------------------------------------------- isolation forest

TREES = 100
SAMPLE = 256


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else (1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    tree = {"feature": [], "cut": [], "left": [], "right": [], "extra": []}

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(tree["feature"])
        for name, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("extra", depth + _average_path(len(rows)))):
            tree[name].append(v)
        spread = x[rows].max(0) - x[rows].min(0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            return at
        f = int(rng.choice(usable))
        col = x[rows, f]
        cut = float(rng.uniform(col.min(), col.max()))
        tree["feature"][at], tree["cut"][at] = f, cut
        tree["left"][at] = add(rows[col <= cut], depth + 1)
        tree["right"][at] = add(rows[col > cut], depth + 1)
        return at

    add(np.arange(len(x)), 0)
    return tree


def isolation_flags(df: DataFrame, cols: list[str], contamination: float = 0.05, key: str = "user_id",
                    trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Outlier score and flag for the most isolated share of rows; fewer than ten rows are never flagged.

    Each tree sees a hash-chosen sample, so about 2 * trees * sample rows are
    shuffled whatever the table's size. Trees grow in parallel; the forest - at
    most trees * 2 * sample nodes - goes to the scoring tasks.
    """
    n = df.count()
    if n < 10:
        return df.select(key, F.lit(0.0).alias("isolation_score"), F.lit(0).alias("temporal_anomaly_flag"))
    x = df.select(key, F.array(*[F.coalesce(c(n_).cast("double"), F.lit(0.0)) for n_ in cols]).alias("x"))
    share = min(1.0, 2.0 * sample / n)
    draw = lambda t: F.pmod(F.xxhash64(c(key), t, F.lit(seed)), F.lit(1_000_000_007))
    picked = x.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < int(share * 1_000_000_007))))
    picked = picked.withColumn("h", draw(c("tree")))
    from pyspark.sql import Window as W
    w = W.partitionBy("tree").orderBy("h", key)
    picked = picked.withColumn("rn", F.row_number().over(w)).where(c("rn") <= sample).select("tree", "rn", "x")
    size = min(sample, n)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        m = np.stack(pdf.sort_values("rn")["x"].to_numpy())
        tree = _grow(m, np.random.default_rng([seed, t]), limit)
        return pd.DataFrame([{"tree": t, **tree}])

    forest = picked.groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, extra array<double>").collect()
    packed = [tuple(np.array(t[f]) for f in ("feature", "cut", "left", "right", "extra")) for t in forest]
    scale = _average_path(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["x"].to_numpy())
            total = np.zeros(len(m))
            for feature, cut, left, right, extra in packed:
                at = np.zeros(len(m), dtype=np.int64)
                for _ in range(limit + 1):
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes = m[np.arange(len(m)), np.maximum(f, 0)] <= cut[at]
                    at = np.where(inner, np.where(goes, left[at], right[at]), at)
                total += extra[at]
            yield pd.DataFrame({key: pdf[key], "isolation_score": np.exp2(-total / len(packed) / scale)})

    scored = x.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, isolation_score double")
    cut = quantiles(scored, [], "isolation_score", {"cut": 1.0 - contamination}).select("cut")           # one row
    return scored.crossJoin(F.broadcast(cut)).select(key, "isolation_score", (c("isolation_score") > c("cut")).cast("int").alias("temporal_anomaly_flag"))


def post_process(fv: DataFrame, key: str = "user_id", contamination: float = 0.05) -> DataFrame:
    """A batch of feature vectors after all users are known: sparse columns imputed, then temporal_anomaly_flag set.

    The five income columns lead the imputation of the eight sparse ones; the flag comes from the imputed cadence
    columns, and is 0 for everyone where fewer than ten vectors exist. Columns and their order stay those of `fv`;
    the key has to be unique. Both steps read the imputed table once stored, so nothing is imputed twice.
    """
    filled = written(knn_impute(fv, K.IMPUTE_REFERENCE, K.IMPUTE_TARGET, key=key), "imputed")
    flags = isolation_flags(filled, K.CADENCE_COLUMNS, contamination, key)
    marked = flags.select(key, c("temporal_anomaly_flag").cast("double").alias("_flag"))
    joined = filled.join(marked, key, "left").withColumn("temporal_anomaly_flag", F.coalesce("_flag", F.lit(0.0)))
    return joined.select(*fv.columns)


# -------------------------------------------------------------- attribution

def linear_attribution(df: DataFrame, weights: dict[str, float], key: str = "user_id") -> DataFrame:
    """Long table of weight * (value - mean): what each feature adds to a linear score."""
    means = df.agg(*[F.avg(c(n).cast("double")).alias(f"_m_{n}") for n in weights])                      # one row
    items = F.array(*[F.struct(F.lit(n).alias("feature"), rnd(w * (c(n).cast("double") - c(f"_m_{n}")), 6).alias("value"))
                      for n, w in weights.items()])
    return df.crossJoin(F.broadcast(means)).select(key, F.explode(items).alias("i")).select(key, "i.*")
