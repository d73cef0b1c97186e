import random

import pytest


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, nulls, empty, repeated and long texts."""
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sá", "të", "wo") for b in ("ra", "ste", "lin", "gou", "n", "x", "p")]
    rows = []
    for i in range(60):
        text = "\n".join(sentence(rng, words, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 8)))
        rows.append([i, text])
    rows.append([60, rows[3][1]])
    rows.append([61, rows[3][1]])
    rows.append([62, rows[7][1] + " tail"])
    rows.append([63, rows[8][1].replace("ra", "ro", 1)])
    shared = sentence(rng, words, 90)
    rows.append([64, "Intro one. " + shared + " and an end"])
    rows.append([65, "Other begin " + shared + "\nmore text"])
    rows.append([66, "x" * 1500])
    rows.append([67, ""])
    rows.append([68, None])
    rows.append([69, " \n\n \t"])
    rows.append([70, sentence(rng, words, 6000)])
    rows.append([71, rows[9][1].upper()])
    rows.append([None, "No id here. " + shared])
    rows.append([72, rows[70][1]])
    rows.append([73, "\n".join([rows[5][1], "lone line", rows[5][1]])])
    rows.append([5, rows[5][1]])  # a repeated row
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with results and helpers."""
    rows = [(*r, 0.5, 1, "x", 7, "y", 3, True) for r in corpus]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, fp string, n long, label string, length int, w boolean"
    return spark.createDataFrame(rows, names).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
