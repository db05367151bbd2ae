import numpy as np

from tracewell.llm import simhash


def test_the_number_of_ranges_is_not_the_clusters(spark):
    """A fingerprint goes to more ranges the more there are; more partitions must not make more of them."""
    rng = np.random.default_rng(1)
    fps = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)], "fp long").distinct()
    before, counts = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            counts.append(len(simhash.upper_nodes(simhash.ranges(fps))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[0] == counts[1] == simhash.FEW
