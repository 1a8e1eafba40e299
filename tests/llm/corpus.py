"""Small corpora with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size long, rank int, hash string"


def rows(seed: int = 5) -> list[tuple]:
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [pick.choice(words) for _ in range(160)]
    texts: list[str | None] = [None, "", "   \n\t ", "one", "One two three four", "one two three FOUR", "é à ü ñ 漢字 " * 30, "x" * 5000, "ab " * 4000]
    for i in range(12):  # near copies of growing distance
        copy = list(base)
        for _ in range(i * 2):
            copy[pick.randrange(len(copy))] = pick.choice(words)
        texts.append(" ".join(copy) + "\n")
    texts += [" ".join(base)] * 5  # exact copies
    passage = " ".join(pick.choice(words) for _ in range(70))
    for _ in range(12):
        texts.append("\n".join((" ".join(pick.choice(words) for _ in range(40)), passage, "Licensed under the same license as all others.", " ".join(pick.choice(words) for _ in range(30)))))
    texts += [" ".join(pick.choice(words) for _ in range(pick.randrange(1, 300))) for _ in range(40)]
    made = [(i * 3 + 1, t, pick.choice(["en", "de", None]), pick.choice(["a", "b", "c", "d", "é", "", None]), len(t or ""), 7, i % 3, "h") for i, t in enumerate(texts)]
    made += [made[20], made[20]]  # repeated rows
    made += [(None, texts[25], "en", "a", 1, 7, 0, "h"), (None, None, None, None, None, None, None, None), (made[30][0], "a repeated id", "en", "a", 1, 7, 0, "h")]
    return made


def documents(spark, parts: int = 3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
