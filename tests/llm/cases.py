"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or add, on purpose.
CLASH = ("size", "ids", "decoded", "spans", "removed", "kept", "_key", "_text", "_copy", "failed", "lang_pred", "score",
         "shard", "slot", "n_bytes", "n_words", "rate", "target", "copies", "kept_bytes")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):03d}" + rng.choice(["", "", ".", ","]) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    shared = prose(2, 60)
    near = prose(3, 120).split()
    return [
        (0, prose(4, 200), "en", "a", 10),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 3),
        (4, long, "en", "a", len(long)),
        (5, prose(5, 40) + " " + shared + " " + prose(6, 40), "de", "b", 1),
        (6, prose(7, 40) + " " + shared + " " + prose(8, 40), None, "b", 1),
        (7, " ".join(near), "de", None, 1),
        (8, " ".join(near[:60] + ["other"] + near[61:]), "de", None, 1),
        (9, " ".join(near), "de", "b", 1),
        (9, " ".join(near), "de", "b", 1),  # the same row twice
        (10, "one two", "en", "c", 7),
        (11, "ONE two", "en", "c", 7),
        (None, "a text without a key " * 8, "en", "c", 1),
        (None, None, None, None, None),
        (12, "12345 !!! ... é中文 \U0001f600 á \x00 �", "fr", "c", 1),
        (13, "a" * 500, "en", "c", 500),
        (13, "b" * 350, "en", "c", 350),  # one key, two texts
    ]


def frame(spark, rows, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if clash:
        df = df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASH))
    return df


def write(spark, folder, rows, name: str = "documents") -> str:
    frame(spark, rows).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
