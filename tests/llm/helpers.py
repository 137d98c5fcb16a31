"""Small inputs for the training-data operators, with every awkward case in them."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names the operators use inside, as extra columns of the input
CLASH = ("keep_id", "kept", "digest", "row", "row_key", "lines", "dropped", "node", "size", "label", "tile", "target",
         "taken", "src", "h", "no_text", "stratum", "score", "held_out", "component_id", "bucket", "_wanted")

WORDS = "the river runs past an old mill where nine quiet people keep bees and sell honey to travellers".split()


def docs(spark: SparkSession, rows, clash: bool = False) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        for i, name in enumerate(CLASH):
            df = df.selectExpr("*", f"'{i}' AS `{name}`")
    return df


def awkward():
    long = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(30_000))
    return [
        (1, "Alpha beta gamma delta epsilon zeta"), (2, "Alpha beta gamma delta epsilon zeta"),
        (3, "Alpha  beta\tgamma delta epsilon zeta"), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
        (8, long), (8, long), (9, "12 34 !!"), (10, "line that is repeated\nother line here\nline that is repeated"),
        (11, "  LINE that is repeated \nlast"), (12, "é漢字😀 mixed letters in one text"), (None, "no id at all, but text"),
        (None, None), (13, "no id at all, but text"), (14, "a\n\n\nb\n"), (15, None, None, None),
    ]
