import random

from tracewell.operators import gathers


def brute(points, k):
    out = set()
    for a, ax, ay in points:
        near = sorted(((x - ax) ** 2 + (y - ay) ** 2, b) for b, x, y in points if b != a)[:k]
        out |= {(a, b, d2, r + 1) for r, (d2, b) in enumerate(near)}
    return out


def test_nearest_of_even_crowded_and_lone_points(spark):
    rng = random.Random(3)
    even = [(i, float(rng.randrange(4000)), float(rng.randrange(4000))) for i in range(150)]
    crowd = [(200 + i, 900.0 + rng.randrange(20), 900.0 + rng.randrange(20)) for i in range(150)]
    far = [(400, 1e6, -1e6), (401, 1e6, -1e6), (402, -5e5, 2.0)]
    points = even + crowd + far
    out = gathers.knn(spark.createDataFrame(points, "id long, x double, y double"), 4, 700.0)
    assert {tuple(r) for r in out.select("id", "neighbour", "d2", "rank").collect()} == brute(points, 4)


def test_fewer_points_than_neighbours(spark):
    points = [(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 9000.0, 0.0)]
    for some in (points, points[:1], []):
        out = gathers.knn(spark.createDataFrame(some, "id long, x double, y double"), 4, 700.0)
        assert {tuple(r) for r in out.select("id", "neighbour", "d2", "rank").collect()} == brute(some, 4)


def test_pairs_grow_with_the_points_not_their_square(spark):
    made = []
    for n in (1000, 4000):
        rng = random.Random(n)
        points = [(i, rng.random() * 2000, rng.random() * 2000) for i in range(n)]
        made.append(gathers.knn_pairs(spark.createDataFrame(points, "id long, x double, y double"), 4, 700.0).count())
    assert made[1] < 8 * made[0] and made[0] < 1000 * 400
