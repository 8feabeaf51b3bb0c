import pytest

#: Documents with every kind of odd row; further columns have the names that operators use inside.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three four"), (6, "one two three four five"), (7, "One TWO three four five"), (7, "One TWO three four five"), (None, "no id here at all"),
    (8, "a b c a b c a b c a b c\n\na b c a b c\n" * 9), (9, "x" * 5000), (10, "word " * 20000), (11, "naïve 😀 Größe     ###* | $ <b> & </turn> 'quoted' \\ \x00 end"), (12, "Line.\nLine.\n \nLine.\n" * 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "row", 1.5, "n", "k", 3, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score double, node string, key string, n_words int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture
def folder(tmp_path):
    """Writes tables to a folder and gives its path."""

    def write(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / "raw" / name))
            part = next((tmp_path / "raw" / name).glob("part-*"))
            part.rename(tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write
