"""The whole run from landed files, on sources shaped from the smallest test tables."""

import os

import pytest

from riskpanel.operators import models
from riskpanel.plans import residential, workflow
from riskpanel.plans.catalog import domain
from riskpanel.plans.catalog.base import Tables
from riskpanel.sources import schemas, sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run_from_landed_files(spark, tmp_path):
    t = Tables(spark, FOLDER)
    landed = tmp_path / "landed"
    shaped = {
        "inspections": domain.inspections(t), "assessments": domain.assessments(t), "liens": domain.liens(t),
        "parcels": domain.parcels(t), "incidents_old": domain.incidents_old(t), "incidents_new": domain.incidents_new(t),
    }
    for key, df in shaped.items():
        sinks.write_csv(df, str(landed / schemas.FILES[key]))
    census = ("income.csv", "built.csv")
    for name, df in zip(census, domain.census_tables(t)):
        sinks.write_csv(df, str(landed / name))

    small = lambda: models.forest(numTrees=2, maxDepth=2)
    settings = workflow.Settings(
        learners={"forest": small}, ranker=small, sweep_learner=small,
        forest_grid={"maxDepth": [2], "numTrees": [2]}, adaboost_grid={"rounds": [1]},
        tuned={"numTrees": 2, "maxDepth": 2}, importance_learner=small, curve_learners={"forest": small},
        curve_folds=2, search_folds=2,
    )
    written = workflow.run(
        spark, str(landed), str(tmp_path / "out"), "r1", domain.PLACE, settings, {"census": census},
        "1999-12-31", "1998-12-31", {"rare_count": domain.RARE, "min_values": 10}, {"until": "2001-12-31"},
    )
    panel = spark.read.parquet(written["panel"])
    direct = residential.residential_panel(domain.prepared(t), until="2001-12-31").panel
    assert panel.count() > 0
    assert sorted(map(str, panel.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))
    assert spark.read.parquet(written["training_matrix"]).count() < panel.count()
    assert spark.read.parquet(written["risk_levels"]).count() == 3
