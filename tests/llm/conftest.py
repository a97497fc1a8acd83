import pytest

#: doc_id, text: nulls, empty and short texts, ties and repeated rows.
AWKWARD = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "   \n\t"), (5, "é漢🙂 'tis"), (5, "é漢🙂 'tis"), (5, "other text of an equal id"), (None, "no id at all"), (None, None), (7, "x" * 3000), (8, "a\x00b")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with an extra column for every internal name."""
    from pyspark.sql import functions as F

    names = ["bpe", "media", "demuxed", "judged", "language", "pii", "secrets", "cleaned", "v_", "s_", "t_", "f_", "p_", "piece_", "salt_", "rank_", "low", "first", "n", "k", "bucket", "turn", "rep", "grp", "h", "g", "pos"]
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({c: F.lit("extra") for c in names})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
