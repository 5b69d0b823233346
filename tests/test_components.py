"""Components put together by one task and by rounds."""

import numpy as np
import pytest

from witness.operators.graph import components


@pytest.mark.parametrize("n", [0, 1, 50, 2000])
def test_few_edges_and_rounds_give_the_same(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(a) - 900, int(b) - 900) for a, b in rng.integers(0, 1800, (n, 2))] + [(10_000 + k, 10_001 + k) for k in range(n)] + [(5, 5)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(5)
    found = [sorted(map(tuple, components(edges, small=small).collect())) for small in (0, 1 << 18)]
    assert found[0] == found[1] and (len(found[0]) > 0) == (n > 0)


def test_few_edges_take_few_stages(spark):
    """Rounds cost the driver its memory: plans, stages and tasks of each are kept."""
    sc = spark.sparkContext
    edges = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    sc.setJobGroup("few", "")
    components(edges).count()
    jobs = sc.statusTracker().getJobIdsForGroup("few")
    sc.setJobGroup("", "")
    assert len(jobs) < 12
