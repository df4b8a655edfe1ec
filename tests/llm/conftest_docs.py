"""Documents with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, hits int, kept int, n_lines int, target int, label_id int, node int"
WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "é", "straße"]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, marks only."""
    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", None), (None, "null id " + words(30, 1), "en", "s", 5), (3, words(30, 2), None, None, None), (4, words(60_000, 3), "en", "s", 9)]
    rows += [(5, words(40, 4), "de", "s", 1)] * 3 + [(6, words(40, 5), "de", "s", 1), (6, words(40, 6), "fr", "s", 1)]
    rows += [(7, "!!! *** ???", "en", "s", 3), (8, "\n\n", "en", "s", 2), (9, "\x00 x\ty", "en", "s", 4), (10, "日本語 テキスト", "ja", "s", 8), (11, words(40, 4).upper(), "de", "s", 1), (None, None, None, None, None)]
    return [r + (1, "r", 2, 3, 4, 5, 6, 7) for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)
