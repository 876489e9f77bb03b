import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a table of documents; further columns clash with names that operators give or might use."""

    def build(texts, ids=None, sources=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            df = df.selectExpr("*", "1 as kept", "'x' as component_id", "2 as spans", "3 as shard", "'y' as copy_", "4.5D as score", "array(1) as ids", "'z' as id", "0 as n", "7 as row", "8 as node")
        return df

    return build


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


@pytest.fixture(scope="session")
def prose():
    """Made-up words, different for each seed."""

    def make(seed, n, base=0):
        import random

        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + str(rnd.randrange(base, base + 300)) for _ in range(n))

    return make


#: Texts that every operator must take: none, empty, blank, one word, a very long one, odd white space, repeats.
@pytest.fixture(scope="session")
def odd_texts(prose):
    return [None, "", " \n\t", "word", prose(1, 20_000), "a\x0bb\x0cc d", "same text here twice over", "same text here twice over", "é漢😀 " * 30, "x" * 70_000]
