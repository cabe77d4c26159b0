import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words in an order that depends on the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


# names that operators use for columns of their own
CLASH = {"size": 1, "key": "k", "n": 2, "doc": 3, "id": 4, "score": 0.5, "n_words": 6, "shard": 7, "kept": "x", "host": "h"}


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    clashing names."""
    rows = [
        (1, prose(1, 60), "en", "a"),
        (2, prose(2, 60), "en", "a"),
        (3, prose(2, 60) + " tail", "en", "b"),
        (4, prose(2, 60), "de", None),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, " \n\t ", "fr", "c"),
        (None, prose(3, 40), "en", "a"),
        (None, None, None, None),
        (8, prose(4, 30), None, "c"),
        (8, prose(4, 30), None, "c"),  # a repeated row
        (9, "one two three", "en", "b"),
        (10, "One TWO\tthree", "en", "b"),
        (11, prose(5, 60_000), "en", "c"),
        (12, "12345 !!! éÉ \U0001f600 ### $$$", "es", "d"),
        (13, "\n".join(["first shared line here", "x", prose(6, 8), "first shared line here"]), "en", "d"),
        (14, "\n".join(["  First SHARED line here\r", "x", prose(7, 8)]), "en", "d"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    schema += ", size int, key string, n int, doc int, id int, score double, n_words int, shard int, kept string, host string"
    return spark.createDataFrame([r + tuple(CLASH.values()) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
