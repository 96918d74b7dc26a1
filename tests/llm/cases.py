"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("row", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("sha", T.StringType()),
    T.StructField("h", T.StringType()), T.StructField("w", T.StringType()), T.StructField("word", T.StringType()),
    T.StructField("keep_id", T.StringType()), T.StructField("score", T.StringType())])


def frame(spark, rows, parts=3):
    """(doc_id, text) pairs as a table with every extra column."""
    full = [(i, t, "en", "s", len(t or ""), *["x"] * 7, None) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)


def texts(seed=1, n=60):
    """Random word texts in which copies, near copies and shared passages are planted."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñü") for _ in range(r.randint(1, 7))) for _ in range(150)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, out = say(70), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            out.append(r.choice(out).upper())
        elif kind == 2:
            out.append(say(r.randint(0, 40)) + "\n" + passage + " " + say(r.randint(0, 30)))
        elif kind == 3 and out:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "zz"
            out.append(" ".join(w))
        elif kind == 4:
            out.append(say(r.randint(1, 12)) + r.choice(["!", "\t", "  x", "'s 12", " y", "<|endoftext|>z"]))
        else:
            out.append(say(r.randint(30, 200)))
    return out


def corpus(seed=1, n=60):
    rows = list(enumerate(texts(seed, n)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, rows[0][1] * 40), (5, rows[5][1]), (5, rows[5][1]), (None, rows[0][1]), (None, None)]
    return rows
