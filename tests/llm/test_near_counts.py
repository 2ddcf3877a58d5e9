"""Links within dense groups of fingerprints against brute force."""

import random

import pytest

from kilnspark.llm import simhash


@pytest.mark.parametrize("radius", [3, 6])
def test_links_of_crowds_are_counted_without_pairs(spark, radius):
    rnd = random.Random(radius)
    marks = {rnd.getrandbits(128) for _ in range(50)}
    for base in [rnd.getrandbits(128) for _ in range(2)]:
        for _ in range(150):
            m = base
            for bit in rnd.sample(range(128), rnd.randrange(0, radius + 3)):
                m ^= 1 << (bit if rnd.random() < 0.3 else bit % 9)
            marks.add(m)
    want = {f"{x:032x}": n for x in marks if (n := sum(x != y and (x ^ y).bit_count() <= radius for y in marks))}
    table = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    assert simhash.balls(table, radius, 8).count() > 100
    assert {r.fingerprint: r.n_near for r in simhash.near_counts(table, radius, 8).collect()} == want
