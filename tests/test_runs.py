import os
import tempfile

from pyspark.ml.classification import LogisticRegressionModel

from tabforge.operators import models as mdl
from tabforge.plans import automl
from tabforge.plans import prep as pp
from tabforge.plans.plan import TaskConfig, ranked_columns, text_report
from tabforge.queries import ORDERS_PLAN, _orders_config
from tabforge.sources import loader
from tabforge.sources.tables import fixture, table

from conftest import SF_SMALL


def test_analyse_report_and_text(spark):
    cust = fixture(spark, SF_SMALL, "customer_gaps")
    cfg = TaskConfig("Supervised", "Classification", target="c_mktsegment")
    report, plan = automl.analyse(cust, cfg)
    assert set(report) == {"numeric", "categorical", "value_counts", "correlations", "missing", "quality"}
    q = report["quality"].first()
    assert 0 <= q.overall_score <= 100
    txt = text_report(plan, cfg, cust.count(), len(cust.columns), q.overall_score)
    assert "Preparation of" in txt and "c_custkey" in txt
    assert ranked_columns(spark, plan, 5).count() <= 5


def test_preview_and_names(spark):
    p = loader.preview(table(spark, SF_SMALL, "customer"))
    assert p["rows"] == table(spark, SF_SMALL, "customer").count()
    assert len(p["preview"]) == 5 and set(p["missing"].values()) == {0}
    assert loader.column_names(table(spark, SF_SMALL, "nation"))[0] == "n_nationkey"


def test_save_load_state_and_model(spark):
    d = tempfile.mkdtemp(prefix="tabforge-save-")
    r = automl.run_supervised(fixture(spark, SF_SMALL, "orders_gaps"), _orders_config(), ORDERS_PLAN,
                              only=["LogisticRegression"])
    r.prep.save(os.path.join(d, "prep"))
    back = pp.FittedPrep.load(os.path.join(d, "prep"))
    model = r.result.models["LogisticRegression"]
    model.write().overwrite().save(os.path.join(d, "model"))
    m2 = LogisticRegressionModel.load(os.path.join(d, "model"))
    o = table(spark, SF_SMALL, "orders")
    a = sorted(tuple(x) for x in mdl.score(o, r.prep, model, keep=["o_orderkey"]).collect())
    b = sorted(tuple(x) for x in mdl.score(o, back, m2, keep=["o_orderkey"]).collect())
    assert a == b and len(a) == o.count()
    assert {x.prediction for x in mdl.score(o, back, m2).collect()} <= {"F", "O", "P", "UNKNOWN"}
