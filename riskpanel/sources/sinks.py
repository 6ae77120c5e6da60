"""Sinks. All write from the executors; a run id names the output instead of the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregate import top_k


def land(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> str:
    """Landed extract as a Parquet table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> str:
    """CSV folder with a header line in every part."""
    df.write.mode(mode).option("header", "true").option("sep", sep).option("escape", '"').csv(path)
    return path


def write_training_matrix(df: DataFrame, path: str, as_csv: bool = False) -> str:
    return write_csv(df, path) if as_csv else land(df, path)


def run_path(folder: str, name: str, run_id: str) -> str:
    return f"{folder.rstrip('/')}/{name}_{run_id}"


def append_sweep(results: DataFrame, folder: str, run_id: str) -> str:
    """Selection results of one run, comma separated, added to the run's folder.

    Results with a ``step`` replace those of the same run and step, so that a
    repeated run does not add its rows again; others are appended.
    """
    path = run_path(folder, "feature_selection_results", run_id)
    if "step" not in results.columns:
        return write_csv(results, path, mode="append")
    # The step stays in the files; its copy names their folders.
    by_step = results.withColumn("run_step", F.col("step")).write.mode("overwrite").partitionBy("run_step")
    by_step.option("partitionOverwriteMode", "dynamic").option("header", "true").option("escape", '"').csv(path)
    return path


def write_importances(importances: DataFrame, folder: str, run_id: str, k: int = 50) -> str:
    best = top_k(importances, "importance", k, ["feature"])
    return write_csv(best, run_path(folder, "feature_importance_list", run_id))
