"""Links at radii other than 2: right, and without the pairs of a crowded bucket."""

import itertools

import numpy as np
import pytest

from sievework.llm import common, simhash


@pytest.mark.parametrize("radius", [1, 3])
def test_a_crowded_bucket_gives_no_more_edges_than_its_words(spark, radius):
    draw = np.random.default_rng(radius)
    prints = sorted({sum(1 << int(b) for b in bits) for n in (0, 1) for bits in itertools.combinations(range(60), n)} | {int(x) for x in draw.integers(0, 1 << 62, 20)})
    plan = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius)
    got = {r.id: r.component for r in common.components(plan).collect()}
    assert {got[p] for p in prints if p.bit_count() <= 1} == {0}
    near = sum((a ^ b).bit_count() <= radius for a, b in itertools.combinations(prints, 2))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "mid" in text and plan.count() <= near
