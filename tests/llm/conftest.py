import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    from ledgerline.llm.tables import load

    return load(spark, SF, "documents").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog sat by the door of the house", "en", "a", 1), (1, "the cat sat on the mat and the dog sat by the door of the house", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0),
        (4, " \n\t ", "fr", "b", 4), (None, "un chat est sur le tapis avec le chien de la maison", "fr", "b", 5), (None, None, None, None, None), (5, long, "en", "c", 9), (6, "1234 5678", "fr", "c", 9), (7, "漢字 İß ſ <|endoftext|> it's", "fr", "d", 2),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.selectExpr("*", "'x' as shard", "1 as score", "2 as row", "3 as slot", "'y' as digest", "4 as spans", "5 as a", "6 as band").cache()
