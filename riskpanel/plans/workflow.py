"""The whole analysis in its order, from a folder of landed files to result tables.

    spark-submit riskpanel/plans/workflow.py <landed folder> <result folder> <run id>
        <city> <municipality> <county subdivision>
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from riskpanel.operators import models
from riskpanel.operators.adaboost import AdaBoost
from riskpanel.operators.metrics import long_report
from riskpanel.plans import cleaning, evaluation, residential
from riskpanel.sources import sinks


def _curve_learners() -> dict[str, Callable]:
    learners = evaluation.default_learners()
    return {
        "adaboost": learners["adaboost"],
        "boosted_trees": learners["boosted_trees"],
        "forest": lambda: models.forest(**models.TUNED_FOREST),
    }


@dataclass(frozen=True)
class Settings:
    """Models and searches of one run; the defaults are the published ones.

    ``use_search_result`` trains the final forest with the best combination of
    the search instead of the fixed settings.
    """

    learners: Mapping[str, Callable] = field(default_factory=evaluation.default_learners)
    ranker: Callable = models.forest
    sweep_learner: Callable | None = None
    forest_grid: Mapping[str, Sequence] = field(default_factory=lambda: models.FOREST_GRID)
    adaboost_grid: Mapping[str, Sequence] = field(default_factory=lambda: models.ADABOOST_GRID)
    search_folds: int = models.SEARCH_FOLDS
    tuned: Mapping = field(default_factory=lambda: models.TUNED_FOREST)
    use_search_result: bool = False
    importance_learner: Callable = models.unsampled_forest
    curve_learners: Mapping[str, Callable] = field(default_factory=_curve_learners)
    curve_folds: int = models.CURVE_FOLDS
    parallelism: int = 4


def evaluate(data: evaluation.Dataset, folder: str, run_id: str, settings: Settings = Settings()) -> dict[str, str]:
    """Fit, select, search and report; every result becomes a table under ``folder``."""
    written: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> None:
        written[name] = sinks.land(df, sinks.run_path(folder, name, run_id))

    data = evaluation.hold(data)
    save("model_reports", long_report(evaluation.compare_models(data, settings.learners), ["model"]))

    sweep, importances = evaluation.selection_sweep(
        data, settings.ranker, settings.sweep_learner, settings.parallelism
    )
    written["selection"] = sinks.append_sweep(sweep, folder, run_id)
    best = evaluation.best_threshold(sweep).first()
    # Without a usable step (no defined F1) all features stay.
    chosen = data if best is None else evaluation.selected(data, importances, best["Thresh"])
    # The rows are cached already; the slices are cheap and cached for the searches.
    chosen = evaluation.hold(chosen) if best is not None else chosen

    summary, best_forest = evaluation.search(
        chosen, models.forest, settings.forest_grid, settings.search_folds, settings.parallelism
    )
    save("forest_search", summary)
    save("forest_search_report", evaluation.search_report(chosen, models.forest, best_forest))
    summary, best_ada = evaluation.search(
        chosen, AdaBoost, settings.adaboost_grid, settings.search_folds, settings.parallelism
    )
    save("adaboost_search", summary)
    save("adaboost_search_report", evaluation.search_report(chosen, AdaBoost, best_ada))

    final = models.forest(**(best_forest if settings.use_search_result else settings.tuned))
    fitted = final.fit(chosen.train)
    save("final_report", long_report(models.model_report("final", fitted, chosen.test), ["model"]))
    scores = models.score_rows(fitted, chosen.test, chosen.order)
    save("final_scores", scores)
    save("risk_levels", evaluation.risk_levels(scores))

    ranking = models.importance_table(
        data.train.sparkSession, settings.importance_learner().fit(data.train), data.names
    )
    written["importances"] = sinks.write_importances(ranking, folder, run_id)

    band, areas = evaluation.curve_bands(
        chosen, settings.curve_learners, settings.curve_folds, settings.parallelism
    )
    save("roc_band", band)
    save("roc_areas", areas)
    evaluation.release(chosen)
    evaluation.release(data)
    return written


def run(
    spark: SparkSession,
    landed: str,
    folder: str,
    run_id: str,
    place: residential.Place,
    settings: Settings = Settings(),
    files: Mapping | None = None,
    train_until: str = residential.TRAIN_END,
    validation_until: str = residential.VALIDATION_END,
    prepare_options: Mapping | None = None,
    panel_options: Mapping | None = None,
) -> dict[str, str]:
    """Read, clean, build and write the panel, then evaluate models on the written panel.

    The options go to ``residential.prepare`` and ``residential.residential_panel``.
    """
    sources = residential.read_sources(spark, landed, files)
    prepared = residential.prepare(sources, place, **(prepare_options or {}))
    result = residential.residential_panel(prepared, **(panel_options or {}))
    panel_path = sinks.land(result.panel, sinks.run_path(folder, "panel", run_id))
    matrix_path = sinks.write_training_matrix(
        residential.training_matrix(result, train_until), sinks.run_path(folder, "training_matrix", run_id)
    )
    data = evaluation.prepare_dataset(
        spark.read.schema(result.panel.schema).parquet(panel_path),
        residential.feature_columns(result),
        cleaning.KEYS,
        train_until,
        validation_until,
    )
    return {"panel": panel_path, "training_matrix": matrix_path, **evaluate(data, folder, run_id, settings)}


if __name__ == "__main__":
    if len(sys.argv) != 7:
        sys.exit(__doc__)
    session = SparkSession.builder.appName("riskpanel").getOrCreate()
    for name, path in run(session, *sys.argv[1:4], residential.Place(*sys.argv[4:7])).items():
        print(f"{name}\t{path}")
