"""The registered forest reads fingerprints of the reference's size."""

import inspect
import os

import pytest

import __spark_entry__  # noqa: F401  importing registers the queries
from hyperclause.operators import training
from hyperclause.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the sample tables are not here")
def test_forest_reads_all_places(spark, monkeypatch):
    fit, asked = training.fit_forest, {}
    assert inspect.signature(fit).parameters["trees"].default == 200

    def few_trees(prints, size, **more):
        asked.update(size=size, bits={r.graph_id: ",".join(map(str, r.bits)) for r in prints.collect()}, more=more)
        return fit(prints, size, trees=2)

    monkeypatch.setattr(training, "fit_forest", few_trees)
    found = registry.QUERIES["tr23_forest_labels"](spark, FOLDER)
    assert asked["size"] == 2048 and not asked["more"]
    assert asked["bits"] == {r.graph_id: r.bits for r in registry.QUERIES["enc22_fingerprints"](spark, FOLDER).collect()}
    assert found.count() == len(asked["bits"])
