import pytest
from pyspark.sql import functions as F

TEXTS = [None, "", " \n\t", "word", "two words", "a b c d e f g h i j", "a b c d e f g h i j",
         "été à l'île ü ß 漢字 の é", "x" * 3000, "rep " * 50, "one\ntwo\none\n \n\none\n",
         "tail with blanks   \n\n", "$$$ ### %%% << >> | & *"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "x", 2.0) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (5, "another text of id five", "de", "s", 1, "x", 2.0), (None, "a b c d e f g h i j", None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words int, node string, key double").withColumns(
            {name: F.lit(1) for name in ("size_", "tie_", "source_", "epochs_", "row", "dropped_tie", "tie", "Size")})


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
