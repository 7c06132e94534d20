import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, rank int"


def docs(spark, texts, ids=None):
    """documents with extra columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2) for i, t in zip(ids, texts)], DOC)


def prose(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéiorstn") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


EDGES = [None, "", " \n\t ", "a", "one two three four", "x" * 5000, "word " * 3000, "naïve café 漢字 \U0001f600 text", "\r\n\r\nWARC/1.1\r\n"]
