import random

from helixframe.llm.common import components


def test_long_paths_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 600)
    links = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[i]) for i in range(301, 400)] + [(names[400], names[400])]
    links += [(names[i], names[j]) for i in range(410, 430) for j in range(i) if j >= 410]
    rng.shuffle(links)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links + links[:50], "a long, b long")).collect()}
    want = {}
    for part in (names[:300], names[300:400], names[410:430]):
        want |= dict.fromkeys(part, min(part))
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
