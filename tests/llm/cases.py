"""Small documents with everything that may go wrong in a table."""

import random

LONG = "lorem ipsum dolor " * 4000


def documents(spark, extra=()):
    """doc_id, text, lang, source, n_chars, with nulls, ties, repeated rows and a long text; clashing names among the extra columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 160))), "en", f"src{rng.randrange(4)}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "de", "src1", 3), (None, "no id at all here", "en", "src2", 5), (None, None, None, None, None)]
    rows += [(103, LONG, "en", "src0", len(LONG)), (104, LONG, "en", "src0", len(LONG)), (105, rows[3][1], "en", "src3", 1), (105, rows[3][1], "en", "src3", 1)]
    rows += [(106 + i, "same text in a hot source", "en", "hot", 25) for i in range(60)]
    rows += list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
