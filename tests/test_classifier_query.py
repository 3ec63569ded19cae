from __future__ import annotations

import os

import pytest
from flowlens.operators import model
from flowlens.plans import training
from flowlens.workload import learning
from pyspark.ml import PipelineModel

FOLDER = "/root/testdata/sf0.01"  # the smallest tables with enough labels to fit


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")
def test_query_fits_the_operators_own_forest(spark, monkeypatch):
    results, train = [], training.train

    def kept(*args, **named):
        results.append(train(*args, **named))
        return results[-1]

    monkeypatch.setattr(training, "train", kept)
    scored = learning.QUERIES["M9_M11_M13_M14_train_and_score"](spark, FOLDER)
    assert scored.where("confidence is null").count() == 0
    forest = PipelineModel.load(results[0].path).stages[-1]
    assert forest.getNumTrees == model.TREES and forest.getMaxDepth() == model.MAX_DEPTH
