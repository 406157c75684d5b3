import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, id string, h long, score double, label int, fp long, c0 string, key string, record string, salt long, shard string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    same = say(40)
    texts = {1: same, 2: same, 3: None, 4: "", 5: "   \n\t", 6: say(60_000), 7: "one", 8: same + " and more", 9: "ünï çødé " * 20, 10: "x" * 50_000}
    rows = [(k, t, "en", None if k == 5 else f"s{k % 2}", None) for k, t in texts.items()]
    rows += [(1, same, "en", "s1", None), (None, same, None, None, None), (None, None, None, None, None), (None, "no id", "en", "s0", 5)]
    return [(*r, *["clash", "clash", 1, 2.0, 3, 4, "c", "k", "r", 5, "s"]) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(11)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
