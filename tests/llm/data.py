"""Small documents with every odd case, and words to make more of."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep string, file string, size long"


def rows(texts, sources=None, ids=None):
    """Rows of DOC; its last columns clash with names the operators use inside."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    sources = ["a"] * n if sources is None else sources
    return [(i, t, "en", s, None if t is None else len(t), "x", None, "f", -1) for i, t, s in zip(ids, texts, sources, strict=True)]


def frame(spark, texts, sources=None, ids=None):
    return spark.createDataFrame(rows(texts, sources, ids), DOC)


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def write(spark, tmp_path, df, name="documents"):
    """As a table of a directory like those of the driver; returns the directory."""
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
