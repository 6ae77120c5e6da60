"""Models, reports and searches on assembled vectors.

Rows stay distributed: forests are Spark ML's, boosting runs on histograms over
binned rows, and the driver only loops over parameters, folds and thresholds. A
learner may offer to score a whole grid from few fits (``shared_scores``) or to
fit all folds on one binning (``fit_folds``); what comes back to the driver is
fitted models and counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import run_parallel
from .boosted import BoostedTrees
from .columns import quoted
from .forests import ProbabilityForest, RandomCutForest, shared_scores
from .metrics import confusion_cells, metric_columns, score_summary
from .timeorder import fold_test, fold_train

# Spark's trees stop at this depth; it stands for "no limit".
MAX_TREE_DEPTH = 30

# The published model and search settings.
SEED = 27
FOREST = {"numTrees": 65, "maxDepth": MAX_TREE_DEPTH}
ADABOOST = {"rounds": 100, "algorithm": "SAMME.R"}
BOOSTED_TREES = {"stepSize": 0.13, "maxIter": 1500, "maxDepth": 3}
SWEEP_FOREST = {"numTrees": 60, "maxDepth": 3}
TUNED_FOREST = {"numTrees": 500, "maxDepth": 10, "featureSubsetStrategy": "log2"}
FOREST_GRID = {
    "maxDepth": [MAX_TREE_DEPTH, 3, 5, 10, 20],
    "featureSubsetStrategy": ["sqrt", "log2"],
    "numTrees": [1, 10, 50, 60, 100, 500],
}
ADABOOST_GRID = {"algorithm": ["SAMME", "SAMME.R"], "rounds": [1, 10, 100, 1000, 10000]}
SEARCH_FOLDS = 3
CURVE_FOLDS = 7


# ---------------------------------------------------------------- data


def temporal_split(
    df: DataFrame,
    period: str,
    train_until: str,
    validation_until: str,
    validation: str = "within",
) -> dict[str, DataFrame]:
    """Train, validation and test rows by date.

    ``within`` trains up to ``train_until`` and validates on the part of the
    training rows up to ``validation_until``. ``holdout`` trains up to
    ``validation_until`` and validates on the rows after it.
    """
    day = quoted(period)
    end, middle = F.lit(train_until).cast("date"), F.lit(validation_until).cast("date")
    upto, test = df.where(day <= end), df.where(day > end)
    early, late = df.where(day <= middle), df.where((day > middle) & (day <= end))
    if validation == "within":
        return {"train": upto, "validation": early, "test": test}
    if validation == "holdout":
        return {"train": early, "validation": late, "test": test}
    raise ValueError("validation is 'within' or 'holdout'")


def assemble(
    df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``label`` (double), ``features`` (vector) and the kept columns; a null feature is an error."""
    safe = {name: f"f{i}" for i, name in enumerate(features)}
    renamed = df.select(
        *[quoted(c) for c in keep],
        quoted(label).cast("double").alias("label"),
        *[quoted(name).cast("double").alias(short) for name, short in safe.items()],
    )
    assembler = VectorAssembler(
        inputCols=list(safe.values()), outputCol="features", handleInvalid="error"
    )
    return assembler.transform(renamed).select(*keep, "label", "features")


def hold(df: DataFrame) -> DataFrame:
    """Keep vectors for repeated fits, spread over all cores; what does not fit in memory goes to disk."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Small tables are merged into one partition by adaptive execution, and a tree's nodes with them.
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def positive_score(column: str = "probability"):
    return F.get(vector_to_array(F.col(column)), 1)


# ---------------------------------------------------------------- learners


def forest(seed: int = SEED, **params) -> ProbabilityForest:
    return ProbabilityForest(seed=seed, **{**FOREST, **params})


def _forest_scores(folded: DataFrame, grid: Mapping[str, Sequence], combos: Sequence[dict], n_splits: int) -> dict:
    return shared_scores({"seed": SEED, **FOREST}, folded, grid, combos, n_splits)


forest.shared_scores = _forest_scores


def boosted_trees(seed: int = SEED, **params) -> BoostedTrees:
    return BoostedTrees(seed=seed, **{**BOOSTED_TREES, **params})


def unsampled_forest(seed: int = SEED, num_trees: int = 10, depth: int = MAX_TREE_DEPTH) -> RandomCutForest:
    """Every tree sees all rows and has random cuts; used for a second ranking of the features."""
    return RandomCutForest(seed=seed, numTrees=num_trees, maxDepth=depth)


# ---------------------------------------------------------------- scoring and reports


def score_rows(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Label, hard prediction and probability of class 1."""
    done = model.transform(df)
    single = isinstance(done.schema["probability"].dataType, T.DoubleType)
    probability = F.col("probability") if single else positive_score()
    return done.select(*[quoted(c) for c in keep], "label", "prediction", probability.alias("score"))


def model_metrics(model, df: DataFrame) -> dict[str, float | None]:
    """All metrics of a model on labelled rows; one job that returns one row."""
    cells = confusion_cells(score_rows(model, df))
    row = cells.select("*", *[v.alias(k) for k, v in metric_columns().items()]).first()
    return row.asDict()


def model_report(name: str, model, df: DataFrame) -> DataFrame:
    """(model, tn, fp, fn, tp, metrics...) on labelled rows."""
    cells = confusion_cells(score_rows(model, df))
    return cells.select(
        F.lit(name).alias("model"), "tn", "fp", "fn", "tp", *[v.alias(k) for k, v in metric_columns().items()]
    )


def importance_values(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Importance per feature, ascending, ties by name; one entry per feature."""
    vector = model.featureImportances
    return sorted(((n, float(vector[i])) for i, n in enumerate(names)), key=lambda nv: (nv[1], nv[0]))


def importance_table(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(importance_values(model, names), "feature string, importance double")


# ---------------------------------------------------------------- selection and search


def select_features(df: DataFrame, names: Sequence[str], chosen: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Slice the vector down to the chosen features, in vector order."""
    position = {n: i for i, n in enumerate(names)}
    slicer = VectorSlicer(
        inputCol="features", outputCol="__slice", indices=sorted(position[c] for c in chosen)
    )
    return slicer.transform(df).select(*[quoted(c) for c in keep], "label", F.col("__slice").alias("features"))


def features_at_least(importances: Sequence[tuple[str, float]], threshold: float) -> list[str]:
    return [name for name, value in importances if value >= threshold]


def sweep_thresholds(importances: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    """Thresholds to try from the ascending importances.

    A value equal to the last threshold is skipped; the smallest importance
    counts as already used and the two largest are left out.
    """
    steps: list[tuple[str, float]] = []
    previous = importances[0][1] if importances else None
    for name, value in importances[:-2]:
        if value != previous:
            steps.append((name, value))
            previous = value
    return steps


SWEEP_SCHEMA = (
    "step int, Last_Feature string, Thresh double, Features int, Acc double, Kapp double, AUC double, "
    "Recall double, Precis double, F1 double"
)


def threshold_sweep(
    train: DataFrame,
    validation: DataFrame,
    names: Sequence[str],
    importances: Sequence[tuple[str, float]],
    learner: Callable | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Refit on ever fewer features and score each step on the validation rows."""
    learner = learner or (lambda: forest(**SWEEP_FOREST))
    steps = list(enumerate(sweep_thresholds(importances)))

    def run(step):
        number, (name, threshold) = step
        chosen = features_at_least(importances, threshold)
        model = learner().fit(select_features(train, names, chosen))
        m = model_metrics(model, select_features(validation, names, chosen))
        return (
            number, name, threshold, len(chosen), m["accuracy"], m["kappa"], m["auc"], m["recall"],
            m["precision"], m["f1"],
        )

    return train.sparkSession.createDataFrame(run_parallel(run, steps, parallelism), SWEEP_SCHEMA)


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_scores(
    folded: DataFrame,
    learner: Callable[..., object],
    grid: Mapping[str, Sequence],
    n_splits: int = SEARCH_FOLDS,
    parallelism: int = 4,
) -> DataFrame:
    """Macro recall of every combination on every expanding fold.

    ``folded`` carries ``label``, ``features`` and ``test_fold``. The result has
    one row per combination and fold. A learner with ``shared_scores`` reads the
    smaller combinations off larger fits.
    """
    combos = list(enumerate(parameter_grid(grid)))
    tasks = [(number, params, fold) for number, params in combos for fold in range(n_splits)]
    shared = getattr(learner, "shared_scores", None)
    known = shared(folded, grid, [params for _, params in combos], n_splits) if shared else None

    def run(task):
        number, params, fold = task
        if known is not None:
            score = known[number, fold]
        else:
            model = learner(**params).fit(fold_train(folded, fold))
            score = model_metrics(model, fold_test(folded, fold))["recall_macro"]
        return (number, *[str(v) for v in params.values()], fold, score)

    fields = ", ".join(f"{name} string" for name in grid)
    schema = f"combo int, {fields}, fold int, score double"
    return folded.sparkSession.createDataFrame(run_parallel(run, tasks, parallelism), schema)


def grid_summary(scores: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    return score_summary(scores, ["combo", *grid])


def best_parameters(scores: DataFrame, grid: Mapping[str, Sequence]) -> dict:
    """Combination with the best mean score, the first one on ties."""
    row = grid_summary(scores, grid).orderBy(F.col("mean_score").desc_nulls_last(), "combo").first()
    return parameter_grid(grid)[row["combo"]]


def fold_scores(
    folded: DataFrame, learners: Mapping[str, Callable[[], object]], n_splits: int = CURVE_FOLDS, parallelism: int = 4
) -> DataFrame:
    """Scores (model, fold, label, score) of every learner refitted on every expanding fold."""
    made = {name: make() for name, make in learners.items()}
    together = {name: learner.fit_folds(folded, n_splits) for name, learner in made.items() if hasattr(learner, "fit_folds")}
    tasks = [(name, fold) for name in learners for fold in range(n_splits)]

    def run(task):
        name, fold = task
        model = together[name][fold] if name in together else learners[name]().fit(fold_train(folded, fold))
        scored = score_rows(model, fold_test(folded, fold))
        return scored.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "label", "score")

    return reduce(DataFrame.unionByName, run_parallel(run, tasks, parallelism))
