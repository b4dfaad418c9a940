import pandas as pd
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Awkward rows that every operator must take: nulls, empty and blank texts, repeated rows, ties, odd characters.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, None, None),
    (4, "one", "en", "s", 3),
    (4, "one", "en", "s", 3),
    (5, "the same words again " * 30, "en", "s", 1),
    (6, "the same words again " * 30, "en", "s", 1),
    (7, "été ñandú straße 漢字 <|endoftext|> \U0001f600 ### | \x1c x y", "fr", "s", 1),
    (None, "no id here at all", "en", "s", 1),
    (8, "line a\nline a\n\nline b\r\nline a", "de", None, 1),
    (9, "w" * 5000, "en", "s", 5000),
    (10, " ".join(f"word{i}" for i in range(6000)), "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows, with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(ODD, DOC_SCHEMA)
    return df.selectExpr("*", "1 AS n_tokens", "'x' AS digest", "2L AS fp", "'k' AS stratum", "3 AS piece")


#: Names of columns that operators use inside, or that their results have.
INSIDE = """_p p row _kept kept _n _c _s _nl _dl _h h _rep _e _q _stratum _base_failed base_failed _salt stratum _mine _id _tie tie lo hi pos hits gone body sha digest rep fp least
component component_id node u v b role piece start length crc row_number rank _b _r _rank _at place toxic votes count n over good held_out lang_pred score rejected n_words n_tokens""".split()


@pytest.fixture(scope="session")
def clashing(spark):
    """The awkward rows with a column for every name that operators use inside."""
    return spark.createDataFrame(ODD, DOC_SCHEMA).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in INSIDE], "1 AS `a.b`")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")
