import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _times string"


def frame(spark, texts, first=0, lang="en", source="s"):
    """A table like documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, lang, source, len(t or ""), "x", "y") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, KINDS)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def changed(words, seed, share):
    r = random.Random(seed)
    return [f"x{r.randrange(10**6)}" if r.random() < share else w for w in words]


def edge_rows(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows and one long text."""
    long = " ".join(prose(99, 30_000))
    rows = [
        (None, None, None, None, None, None, None), (None, "no id " * 30, "en", "s", 1, None, None), (1, None, "en", "s", 0, "x", "y"), (2, "", "en", "s", 0, "x", "y"),
        (3, " \t\n ", None, "s", 4, "x", "y"), (4, "one", "en", None, 3, "x", "y"), (5, "same text " * 40, "en", "s", 400, "x", "y"), (5, "same text " * 40, "en", "s", 400, "x", "y"),
        (6, "same text " * 40, "en", "s", 400, "x", "y"), (7, long, "en", "t", len(long), "x", "y"), (8, "é梦 𝄞 ▁x  y\n" * 20, "fr", "t", 1, "x", "y"), (9, long + " end", "en", "t", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, KINDS)
