import duckdb
import pytest

from formbook.llm.common import ready

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


LONG = "One word after another, again and again, in a very long text. " * 4000
ODD = [
    (1, "The cat sat on the mat and the dog sat on the log.", "en", "a"),
    (1, "The cat sat on the mat and the dog sat on the log.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", None),
    (4, " \n\t ", None, "b"),
    (5, LONG, "en", "b"),
    (6, "12 34 !!! ### <|endoftext|> é中\U0001f642", "fr", "c"),
    (None, "Ein Text ohne Nummer.", "de", "c"),
    (None, None, None, None),
    (7, "Under the MIT License. Under the MIT license", "en", "d"),
]
# Extra columns whose names the operators use themselves.
CLASHING = ("lang_pred", "score", "fp", "label", "chunk", "rest", "n_words", "failed", "k", "file", "group")


@pytest.fixture(scope="session")
def odd(llm):
    rows = [(*r, *["x"] * len(CLASHING)) for r in ODD]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return llm.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
