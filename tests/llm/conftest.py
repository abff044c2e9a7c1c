import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank long, score double, line int, fp long, a string, item_id long"
    one = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n ", "en", None, 5), (4, one, "en", "s", len(one)), (4, one, "en", "s", len(one)),
        (4, one + " x", "en", "s", 5), (None, one, "en", "s", None), (None, None, None, None, None), (5, "\n".join([one, "", "b", "c", one, "b", "c"]), "fr", "s", 1),
        (6, "word " * 40_000, None, "s", 1), (7, "x" * 100_000, "fr", "s", 1), (8, "1234 !!!   ", "fr", "s", 1), (9, "<|endoftext|> a\x1cb <|startoftext|>", "en", "s", 1),
        (10, "é İstanbul 한글 \U0001f600", "en", "s", 1),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, 2, 3, "a", 4) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con
