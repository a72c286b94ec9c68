import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["_r1", "_r2", "fp", "of", "part", "size", "rest", "row", "_id", "parts", "target", "leaf", "value", "pos", "line", "keeper", "key", "gone", "copies", "score", "label", "_b", "_to", "own", "following", "digest"]


def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies, repeated lines."""
    words = [f"w{i % 97}x{i % 13}" for i in range(400)]
    line = "This line stands in very many of the documents, word for word."
    out = [
        (1, None, "en", "b", None), (2, "", None, "a", 0), (3, "   \n\t ", "en", None, 7), (None, "a text without an id but some words in it", None, None, 3), (None, None, None, None, None),
        (4, "same text", "en", "a", 9), (5, "same text", "en", "b", 9), (5, "same text", "en", "b", 9), (6, " ".join(words), "de", "c", 1), (7, " ".join([*words[:-1], "other"]), "de", "c", 1),
        (8, " ".join(reversed(words)), "fr", "a", 1), (9, "x" * 50_000, "en", "a", 1), (10, "long " * 30_000, "en", "b", 1), (11, "émigré Ünïcode 𝒳 text\r\nwith\x0bodd\x0cspaces", "fr", "c", 5),
    ]
    out += [(20 + i, f"Start {i}\n  {line.upper() if i % 2 else line}\t\nEnd {i}\n", "en", "d", 1) for i in range(7)]
    out += [(-4, "negative id text with five words", "en", "a", 2)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="session")
def wide(docs):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
