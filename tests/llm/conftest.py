import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, anchor int, path string, bucket int, n int, word string, rank int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, wordless and very long texts, repeated rows, a null id, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(k * 7 + k // 10) % 10] + str(k % 977) for k in range(60_000))
    prose = "The quick brown fox jumps over the lazy dog and runs into the deep green forest at night."
    texts = [(1, prose), (1, prose), (2, None), (3, ""), (4, "!!! ... 。"), (5, long), (6, long[:200_000]), (None, prose + " More."), (7, "été Ünïcode \U0001f600 mail a.b@c.example.org"), (8, "one"), (9, "one"), (10, "\n\n  two  spaced\twords <|endoftext|> \n")]
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else f"src{i}", None if t is None else len(t), "k", 1, 1, "p", 1, 1, "w", 1) for i, t in texts]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
