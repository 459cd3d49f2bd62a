import pytest

from brokerlens.session import configure

# Null, empty, blank, repeated and very long texts; symbols outside the basic plane; a null key and a null source.
TEXTS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, "en", "a", 0),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "de", None, 4),
    (5, "one two three four five six seven", "en", "a", 33),
    (5, "one two three four five six seven", "en", "a", 33),
    (6, "x" * 120_000 + " end", "fr", "b", 120_004),
    (7, "😀 naïve café — 漢字\nline\nline\n" * 30, None, "b", 0),
    (None, "no key here at all", "en", "a", 18),
    (8, " ".join(f"w{i % 7}" for i in range(5000)), "en", "b", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside and in their results.
CLASHING = ["score", "predicted", "fp", "fingerprint", "component_id", "kept", "host", "lines", "key", "shard", "size", "row", "k", "body", "h", "y"]


@pytest.fixture(scope="session")
def corpus(spark):
    configure(spark)
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="session")
def crowded(corpus):
    """The corpus with extra columns whose names clash."""
    from pyspark.sql import functions as F

    return corpus.select("*", *(F.lit(name).alias(name) for name in CLASHING))


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("false")
