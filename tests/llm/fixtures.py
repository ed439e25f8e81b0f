"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use for their own.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, size string, spans string, n_words string, fingerprint string"


def rows(seed: int = 7, count: int = 60):
    """(doc_id, text, lang, source, n_chars)"""
    draw = random.Random(seed)
    words = ["the", "thé", "of", "Erst", "naïve", "数", "token", "ab", "deadbeef", "😀", "x" * 40, "and", "to", "###", "was,"]
    made = []
    for n in range(count):
        size = draw.choice([0, 1, 2, 3, 10, 80, 400])
        text = draw.choice([" ", "\n", "\t", " "]).join(draw.choice(words) for _ in range(size))
        made.append((n, text, draw.choice(["en", "de", None]), draw.choice(["a", "b", "Z", None]), len(text)))
    long = " ".join(draw.choice(words) for _ in range(30_000))
    made += [
        (100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \n\t\r\v\f ", None, None, 7),
        (103, made[5][1], "en", "a", 1), (104, made[5][1].upper(), "en", "b", 1), (105, made[5][1], "en", "b", 1),
        (105, made[5][1], "en", "b", 1), (None, made[5][1], "en", "b", 1), (None, "a text of no id", None, "b", 1), (None, None, None, None, None),
        (106, long, "en", "a", len(long)), (107, long + " tail", "en", "a", len(long)), (108, "y" * 200_000, "en", "a", 200_000), (109, " " * 70_000 + "z", "en", "a", 70_001),
        (-4, "negative id", "en", "b", 11), (110, "line\n" * 300, "en", "b", 1500), (111, "İſK é́ \x1c \x85   word", "tr", "c", 20),
    ]
    return made


def table(spark, rows_, parts=3):
    return spark.createDataFrame(rows_, SCHEMA).repartition(parts)


def extra(spark, rows_):
    return spark.createDataFrame([(*r, "i", "k", "s", "p", "n", "f") for r in rows_], EXTRA)


def ordered(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)
