"""Small documents that hold the hard cases: nulls, empty and long texts, repeats, ties."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=60, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Größe", "niño", "été", "x-1", "A.B"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 34, 35, 36, 80, 200]))]
        text = " ".join(words)
        if i % 5 == 0:
            at = rng.randrange(len(words) + 1)
            text = " ".join(words[:at] + passage.split()[rng.randrange(10) :] + words[at:])
        if i % 7 == 0 and out:
            text = out[-1][1] or ""
        if i % 11 == 0 and out:
            text = (out[-1][1] or "") + " tail\tend"
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(text)))
    long = " ".join(rng.choice(vocab) for _ in range(20000))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t", "en", "s1", 3), (n + 3, "go " * 100, "en", "s2", 300)]
    out += [(n + 4, long, "en", "s1", len(long)), (n + 5, "a b", "en", "s1", 3), (n + 6, "a b", "en", "s1", 3)]
    out += [(n + 7, "same row twice " * 20, "en", "s1", 300)] * 2
    return out


def frame(spark, data=None):
    """With extra columns whose names clash with what the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("shard", "bucket", "size", "words", "fp", "n_words", "row", "root", "kinds", "found", "text_key", "held", "t", "ws", "codes", "same", "d2", "leaf", "doc", "line", "place", "key")})


def with_own_names(df):
    """With extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("__n", "__key", "__fp", "__at", "__nth", "__same", "__group", "__keep", "__source", "__text_key", "__spans", "__bad")})
