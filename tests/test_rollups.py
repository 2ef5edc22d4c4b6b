import math
import random

from daftar.operators.rollups import exact_quantiles


def test_quantiles_are_exact(spark):
    """Against sorting, with ties, one value, huge ranges, NULL keys and missing values; few parts, so many rounds."""
    rng = random.Random(3)
    groups = {
        "ties": [float(rng.randrange(5)) for _ in range(900)],
        "one": [3.5],
        "same": [2.0] * 50,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308) for _ in range(700)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
        "close": [1.0 + i * 2.0**-52 for i in range(300)],
        None: [rng.random() for _ in range(400)],
    }
    rows = [(k, v) for k, some in groups.items() for v in some] + [("ties", None), ("ties", math.nan), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.95, 1.0]
    for buckets in (1024, 3):
        some = df if buckets > 3 else df.where("key is null or key in ('ties', 'close', 'one')")
        got = {(r.key, r.q): r.value for r in exact_quantiles(some, qs, buckets).collect()}
        keys = list(groups) if buckets > 3 else [None, "ties", "close", "one"]
        want = {(k, q): sorted(groups[k])[max(1, math.ceil(q * len(groups[k]))) - 1] for k in keys for q in qs}
        assert got == want
