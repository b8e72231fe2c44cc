"""Small tables with the odd rows that every operator must take."""

import re
import zlib

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))

PLAIN = ("The river was low that year and the boats lay on the sand for weeks. People walked across "
         "to the other bank and sold apples, bread and cheese there.\nNobody remembered a drier summer "
         "than this one, and the old men said so every evening.")


def rows():
    """(doc_id, text) with nulls, empty and blank texts, repeated rows, equal
    texts, equal ids and one very long text."""
    return [
        (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, PLAIN + " Then it rained."), (4, ""), (5, None), (6, " \n\t "),
        (None, "no id here but some words to count"), (None, None), (7, LONG), (8, "one"),
        (9, "Ünïcode wörds; ñandú — 日本語 текст"), (9, "same id, other text"), (10, "a b a b a b a b a b a b"),
        (11, "line\nline\nline\n\nother\r\nother\r\n"), (-5, "negative id"),
    ]


def frame(spark, found=None):
    """The rows with extra columns named like operators' own."""
    found = rows() if found is None else found
    return spark.createDataFrame(
        [(i, t, "x", 1, None, True, 0.5) for i, t in found],
        "doc_id long, text string, shard string, n_words int, _rf long, kept boolean, score double")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fold(doc_id, folds):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def collected(df):
    return [r.asDict() for r in df.collect()]
