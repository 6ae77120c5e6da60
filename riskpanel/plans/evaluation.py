"""Model evaluation on a panel: splits, reports, selection, searches, risk levels and ROC bands."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import models
from ..operators.adaboost import AdaBoost
from ..operators.aggregate import best_row, top_k, union_all_names
from ..operators.curves import roc_band
from ..operators.metrics import classification_report, confusion_cells, risk_histogram
from ..operators.timeorder import expanding_folds, forward_fill
from ..session import cut_lineage


@dataclass(frozen=True)
class Dataset:
    """Assembled vectors with their period and keys, split by time."""

    names: list[str]
    order: list[str]
    train: DataFrame
    validation: DataFrame
    test: DataFrame


def prepare_dataset(
    panel: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    train_until: str,
    validation_until: str,
    validation: str = "within",
    label: str = "target",
    period: str = "period",
    carry_forward: bool = False,
) -> Dataset:
    """Vectors once for all fits. ``carry_forward`` fills missing features from the last period of the area."""
    if carry_forward:
        panel = forward_fill(panel, keys, [period], [label, *features])
    rows = models.assemble(panel, features, label, [period, *keys])
    parts = models.temporal_split(rows, period, train_until, validation_until, validation)
    return Dataset(list(features), [period, *keys], parts["train"], parts["validation"], parts["test"])


def hold(data: Dataset) -> Dataset:
    return Dataset(
        data.names, data.order, models.hold(data.train), models.hold(data.validation), models.hold(data.test)
    )


def release(data: Dataset) -> None:
    for part in (data.train, data.validation, data.test):
        part.unpersist()


def default_learners() -> dict[str, Callable]:
    """The three compared models with their published settings."""
    return {
        "forest": models.forest,
        "adaboost": lambda: AdaBoost(**models.ADABOOST, seed=models.SEED),
        "boosted_trees": models.boosted_trees,
    }


def compare_models(data: Dataset, learners: Mapping[str, Callable] | None = None) -> DataFrame:
    """One row of cells and metrics per model, fitted on train and scored on test."""
    reports = [
        models.model_report(name, make().fit(data.train), data.test)
        for name, make in (learners or default_learners()).items()
    ]
    return union_all_names(*reports)


def ranked_features(data: Dataset, learner: Callable = models.unsampled_forest, k: int = 20) -> DataFrame:
    model = learner().fit(data.train)
    table = models.importance_table(data.train.sparkSession, model, data.names)
    return top_k(table, "importance", k, ["feature"])


def selection_sweep(data: Dataset, ranker: Callable = models.forest, learner: Callable | None = None, parallelism: int = 4):
    """(sweep table, importances): refits on ever fewer features, scored on the validation rows."""
    importances = models.importance_values(ranker().fit(data.train), data.names)
    sweep = models.threshold_sweep(data.train, data.validation, data.names, importances, learner, parallelism)
    return sweep, importances


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Sweep row with the best F1, the first one on ties."""
    return best_row(sweep, "F1", ["step"])


def selected(data: Dataset, importances, threshold: float) -> Dataset:
    """The data set cut down to the features at or above a threshold."""
    chosen = models.features_at_least(importances, threshold)

    def cut(part: DataFrame) -> DataFrame:
        return models.select_features(part, data.names, chosen, data.order)

    ordered = [n for n in data.names if n in set(chosen)]
    return Dataset(ordered, data.order, cut(data.train), cut(data.validation), cut(data.test))


def search(
    data: Dataset,
    learner: Callable[..., object],
    grid: Mapping[str, Sequence],
    n_splits: int = models.SEARCH_FOLDS,
    parallelism: int = 4,
) -> tuple[DataFrame, dict]:
    """(summary per combination, best parameters) by macro recall on expanding folds."""
    folded = models.hold(expanding_folds(data.train, data.order, n_splits))
    scores = models.grid_scores(folded, learner, grid, n_splits, parallelism)
    folded.unpersist()
    return models.grid_summary(scores, grid), models.best_parameters(scores, grid)


def search_report(data: Dataset, learner: Callable[..., object], best: Mapping) -> DataFrame:
    """Refit with the best parameters and report per class on the test rows."""
    model = learner(**best).fit(data.train)
    return classification_report(confusion_cells(models.score_rows(model, data.test)))


def tuned_scores(data: Dataset, params: Mapping | None = None) -> DataFrame:
    """Test rows scored by the final forest; ``params`` overrides its published settings."""
    model = models.forest(**{**models.TUNED_FOREST, **(params or {})}).fit(data.train)
    return models.score_rows(model, data.test, data.order)


def risk_levels(scores: DataFrame) -> DataFrame:
    return risk_histogram(scores, "score")


def curve_bands(
    data: Dataset, learners: Mapping[str, Callable], n_splits: int = models.CURVE_FOLDS, parallelism: int = 4
) -> tuple[DataFrame, DataFrame]:
    """ROC bands and mean areas of several models over expanding folds of the training rows."""
    folded = models.hold(expanding_folds(data.train, data.order, n_splits))
    # Both tables read the scores, so the models run once and the vectors can go.
    scores = cut_lineage(models.fold_scores(folded, learners, n_splits, parallelism))
    folded.unpersist()
    return roc_band(scores, "score", "label")
