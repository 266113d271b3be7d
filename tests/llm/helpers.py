"""Small tables with every awkward case, shared by the tests of this folder."""

from pyspark.sql import DataFrame, SparkSession

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, kept boolean, m int, _row long, "
    "_id long, length long, start long, kind string, component_id long, value string, stage int"
)
EXTRA = (1, True, 2, 3, 4, 5, 6, "k", 7, "v", 8)
LONG = " ".join(f"wort{i % 977}x{i % 89}" for i in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog and then it runs far away from the big house in the wood."


def awkward(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows`` are (doc_id, text, lang); the other columns have names that operators use inside."""
    full = [(i, t, g, "s", None if t is None else len(t), *EXTRA) for i, t, g in rows]
    return spark.createDataFrame(full, COLUMNS)


ROWS = [
    (1, PLAIN, "en"), (2, PLAIN, "en"), (2, PLAIN, "en"), (3, None, "en"), (4, "", None), (5, " \t\n ", "fr"),
    (6, LONG, "de"), (None, PLAIN + " x", "en"), (7, "a", "en"), (8, "ÄÖ ü€😀 漢字 " * 60, None), (9, LONG + " ende", "de"),
    (10, "one two three four five " * 40, "en"), (None, None, None), (11, PLAIN.upper(), "en"),
]
