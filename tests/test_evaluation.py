import hashlib

import numpy as np
import pytest

from quarrymill.operators import evaluate
from quarrymill.plans import registry
from tests.compare import SF


@pytest.mark.parametrize("name", ["bootstrap_ci_10000", "paired_bootstrap_ci_10000"])
def test_the_intervals_rest_on_ten_thousand_resamples(spark, name):
    assert registry.QUERIES[name](spark, SF).first().resamples == 10_000


def test_bootstrap_by_hand(spark):
    """Two rows: some resamples draw neither."""
    data, means = [(1, 0.25), (2, 1.0)], []
    for resample in range(40):
        u = [int(hashlib.md5(f"{resample}-{k}".encode()).hexdigest()[:8], 16) / 2**32 for k, _ in data]
        w = [sum(x >= p for p in evaluate.POISSON) for x in u]
        means += [np.average([v for _, v in data], weights=w)] if sum(w) else []
    assert 0 < len(means) < 40
    found = evaluate.bootstrap(spark.createDataFrame(data, "k bigint, v double"), "k", "v", 40).first()
    assert (found.resamples, found.low, found.high) == (40, pytest.approx(np.percentile(means, 2.5), abs=1e-6), pytest.approx(np.percentile(means, 97.5), abs=1e-6))
