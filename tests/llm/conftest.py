import random
import zlib

import pytest

WORDS = "the of and to in is was for on that with as his they at be this from have or by one had not but what all were when we there can an your which".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token string, node long, class_ int, size long, bucket long"


def rows_of(pairs):
    return [(i, t, lang, "s", len(t or ""), 0.5, "x", 1, 2, 3, 4) for i, t, lang in pairs]


@pytest.fixture(scope="session")
def sentence():
    def make(rng, n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def cases(spark, sentence):
    """Ordinary documents and the odd ones: null, empty, blank, one word, very long, repeated rows, a null id, columns of clashing names."""
    rng = random.Random(4)
    pairs = [(i, sentence(rng, rng.randint(30, 200)), rng.choice(["en", "de"])) for i in range(40)]
    base = pairs[3][1]
    pairs += [(100, base, "en"), (101, base.replace("the", "a", 1), "en"), (102, None, "en"), (103, "", None), (104, " \n\t ", "en"), (105, "word", "de"), (None, sentence(rng, 50), "en"), (None, None, None)]
    pairs += [(106, sentence(rng, 60_000), "en"), (107, "ünïcödé 世界 \U0001f600 " * 30, "de"), (50, pairs[5][1], "en"), (50, pairs[5][1], "en"), (108, "7 8 9 !!", "en")]
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(cases):
    return cases.limit(0)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n
