import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, registers string, predicted string"


def table(spark, texts, ids=None, lang="en"):
    """documents with extra columns whose names clash with results'."""
    rows = [(i if ids is None else ids[i], t, lang, "src0", None if t is None else len(t), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng: random.Random, words: int, vocabulary=None) -> str:
    syllables = "the an in re er on at or es ing ou tion sh ea ly st nd".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


ODD = [None, "", "   \n\t ", "a", "same text here", "same text here", "x" * 50_000, "wörd " * 20_000, "日本語 текст ελληνικά", "\x00\x01"]
