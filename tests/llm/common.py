"""Small tables for the operators' tests."""

import random

WORDS = "the of and tion er on re thing stone river cloud amber quick lazy fox dog über señal déjà 42 it's e.g.".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS), ","]) for _ in range(n))


#: doc_id, text: nulls, empty and white texts, repeats, ties, a long text, odd characters.
BASE = prose(1, 150)
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, BASE + " more"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, prose(2, 90) + " " + BASE),
    (7, prose(2, 90) + " " + BASE),
    (8, prose(3, 6000)),
    (9, "  Two  spaces\nand\r\nlines\x0b "),
    (10, " Two spaces and lines "),
    (11, "İstanbul ΑΣ ß    é \U0001f600 a\x1cb \x85 <|endoftext|>"),
    (None, BASE),
    (None, "nobody knows"),
    (12, "x"),
    (13, "ab " * 400),
]
#: Columns that operators use inside.
CLASHING = "shard size old block row rep hash content n_bytes leaf group node cluster size text_hash spans score".split()


def table(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if clash:
        for name in dict.fromkeys(CLASHING):
            df = df.selectExpr("*", f"'odd' AS {name}")
    return df


def empty(spark):
    return table(spark, [])


def save_documents(spark, path, rows):
    """A folder of tables as the registered queries take it."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.selectExpr("*", "'en' AS lang", "'src' AS source", "length(text) AS n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)
