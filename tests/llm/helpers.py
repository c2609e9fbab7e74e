"""Small inputs with every defined case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid long, size long"


def frame(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        doc_id = i if ids is None else ids[i]
        source = f"s{i % 3}" if sources is None else sources[i]
        rows.append((doc_id, t, "en", source, None if t is None else len(t), "extra", 7, -1))
    return spark.createDataFrame(rows, DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near(rng: random.Random, text: str, edits: int) -> str:
    own = text.split()
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
    return " ".join(own)


ODD_TEXTS = [None, "", " ", "\n\t\x0b\x0c\r", "a", "a b", "A  b", "é\u00a0ß 日本", "x" * 70_000, "same text here", "same text here", "same\ttext\nhere "]
