"""Every query with SQL gives the same rows as that SQL on DuckDB; the others give rows."""

import pytest

from drillframe import catalogue
from drillframe.plans import model

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(catalogue.QUERIES[name](spark, sf), sf, catalogue.SQL[name]) == []


@pytest.mark.parametrize("name, settings", [("q_model_predictions", model.ACROSS), ("q_retrospective", model.WITHIN), ("q_importances", model.ACROSS)])
def test_models_are_fitted_with_their_own_settings(spark, sf, monkeypatch, name, settings):
    asked, fit = [], model.fit

    def small(train, names, label="rop", settings=None):
        asked.append(settings)
        return fit(train, names, label, settings | {"maxIter": 10, "maxDepth": 2})

    monkeypatch.setattr(model, "fit", small)
    assert catalogue.QUERIES[name](spark, sf).count() > 0
    assert asked == [settings]
