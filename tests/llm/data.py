"""Small documents with all that operators must bear: nulls, empty and long texts, copies, clashing names."""

import random

WORDS = "red blue green stone river cloud paper light north south early late small large open close with from into over under after before again never always".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def documents(spark, seed=3, n=60):
    draw = random.Random(seed)
    texts = [prose(draw, draw.randint(1, 120)) for _ in range(n)]
    for _ in range(n // 2):  # near and exact copies
        words = draw.choice(texts[:n]).split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "edited" + str(draw.randrange(9))
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "one", "one two", "ONE TWO", "\n\na\n", prose(draw, 6000), "x" * 50_000, "naïve 😀 straße " * 30, "\u0085 \x1c odd 　 space"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None), (None, None, None, None, None), (5, "another text with the id of five", "en", "src", 1)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def with_clashes(df):
    """Extra columns named as operators name their own."""
    from pyspark.sql import functions as F

    for name in ("id", "body", "key", "node", "n", "sha", "print", "no", "set", "sig", "line", "kept", "score", "shard", "length", "word", "root", "class", "document", "of", "__own_sha", "v", "html_text"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
