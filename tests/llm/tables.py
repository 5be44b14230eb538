"""Small tables with awkward rows, shared by the tests of this folder."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Originals, exact copies, near copies of many strengths, shared passages, and rows of every odd kind."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(30):
        texts.append(" ".join(sentence(rng, rng.randint(20, 200))))
    base = sentence(rng, 150)
    for k in range(80):  # a family whose members differ in 0 to 12 words
        own = list(base)
        for _ in range(k % 13):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    passage = sentence(rng, 70)
    for _ in range(12):
        texts.append(" ".join(sentence(rng, 40) + passage + sentence(rng, 30)))
    texts += [texts[0]] * 5 + [texts[3].upper()]
    texts += [None, "", "   \t\n", "one", "one two three", "One TWO three", "four words only here", "é ü ß Ä x y z"]
    texts.append(" ".join(sentence(rng, 30_000, 10**6)))  # very long
    texts.append("same " * 3000)
    texts.append("x" * 50_000)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None) for i, k in enumerate(order)]
    return rows + [rows[4], rows[4], (None, "a row without an id", "en", "a", 19)]


def frame(spark: SparkSession, rows: list[tuple], schema: str = DOCUMENTS) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(5)


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(UPPER) if lower else (text or ""))
