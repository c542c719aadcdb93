"""As many replicates as the reference draws, and the interval they give."""

import statistics

from ringledger.plans import registry
from ringledger.plans.base import predictions

FOLDER = "/root/testdata/sf0.001"


def test_thousand_replicates(spark):
    hits = [float((x["p"] >= 0.6) == x["won"]) for x in predictions(spark, FOLDER).collect()]
    mean, error = statistics.fmean(hits), statistics.pstdev(hits) / len(hits) ** 0.5
    (got,) = registry.queries()["so13_bootstrap"](spark, FOLDER).collect()
    assert got["replicates"] == 1000
    assert abs(got["lo"] - (mean - 1.96 * error)) < 0.25 * error and abs(got["hi"] - (mean + 1.96 * error)) < 0.25 * error
