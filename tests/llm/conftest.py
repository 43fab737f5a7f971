import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        # names that the operators use for columns of their own
        "id long, hash long, key long, features array<double>, score double, quota long, grp long, _row int, size string")
LONG = " ".join(f"word{i % 977} {i}" for i in range(60_000))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 8, 9, [0.5], 1.5, 3, 4, 5, "six")


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    same = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [_row(1, same), _row(2, same), _row(2, same), _row(3, same.upper()), _row(4, ""), _row(5, None),
            _row(None, same, None, None), _row(6, " \n\t "), _row(7, "one two"), _row(8, "one two", None, None),
            _row(9, LONG), _row(10, LONG + " tail"), _row(11, "été à l'école\n" * 3, "fr"), _row(12, "1234 5678 !!", "de"),
            (None,) * 14]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
