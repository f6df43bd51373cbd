import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows that are awkward for every operator: nulls, empties, blanks, copies, repeats, a very long text, all languages."""
    rng = random.Random(7)
    words = [a + b for a in "ka lo mi né su ta".split() for b in "ron sel tum vip ßen zar".split()]

    def prose(n):
        out = [rng.choice(words) for _ in range(n)]
        for k in range(11, n, 12):
            out[k] += rng.choice([".", ".\n", ",", "!", ";"])
        return " ".join(out).replace("\n ", "\n")

    base = [prose(rng.randint(30, 120)) for _ in range(30)]
    texts = [*base, base[0], base[0].replace(" ", "  "), base[1] + "\n", base[2], None, None, "", " \t\n", "x", "?!",
             "one two", prose(6000), "A\x1cB \x85 C\xa0D", "日本語 テキスト", "<|endoftext|> hi", base[3], base[3]]
    rows = [(k, t, ["en", "de", None][k % 3], ["hot", "hot", "s1", None][k % 4], None if t is None else len(t))
            for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[6], "en", "hot", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample_dir():
    return "/root/testdata/sf0.1"
