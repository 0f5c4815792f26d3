"""Inputs and plain-Python definitions that the tests share."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(seed: int, n: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """(doc_id, text, source): copies, near copies, nulls, blanks, long texts, repeated rows."""
    a = prose(1, 60)
    near = a.replace(" ", "  ", 3).split()
    near[30] = "changed"
    long = prose(2, 40000, 30000)
    rows = [(1, a, "s1"), (2, a, "s1"), (3, " ".join(near), "s2"), (4, None, "s2"), (5, "", None), (6, " \n\t ", None),
            (7, long, "s1"), (8, "one two three", "s3"), (9, "One TWO three", "s3"), (8, "one two three", "s3"),
            (None, a, "s1"), (10, long + " tail", "é"), (11, "x" * 50000, "s1"), (12, a.upper(), None),
            (13, "\n".join([a, "line two is here now", a]), "s2"), (14, "\U0001f600     ok", "s1")]
    return rows + [(20 + i, prose(i, 30 + i), f"s{i % 4}") for i in range(30)]


#: Names that the operators use inside, as columns of the user's.
CLASHING = ["id", "size", "file", "row", "_file", "_row", "_times", "_lost", "kept", "digest", "n", "node", "rank", "block",
            "length", "spans", "u", "v", "copies", "target", "piece", "line", "class", "first", "url_", "turns", "host"]


def as_docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles_of(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
