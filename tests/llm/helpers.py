from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, hash long, component string, terms string, bits double, a long, b long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own; rows of (doc_id, text[, lang])."""
    full = [(i, t, *(rest or ("en",)), "src0", None if t is None else len(t), 7, 7, "x", "x", 1.0, 1, 1) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng: random.Random, n: int, syllables=("the", "an", "er", "ti", "on", "ha", "nd", "re")) -> str:
    words = []
    for _ in range(n):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
        words.append(w + rng.choice(["", "", "", ".", ",", "\n"]))
    return " ".join(words)


#: Null, empty, blank, short, special, very long and repeated rows, equal texts, a null doc_id.
def odd_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 40)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a <|endoftext|> b  c\n \nd"), (6, long), (7, same), (8, same), (8, same), (None, same), (None, None),
        (9, "é 漢字 \U0001f600 " + same), (10, "x" * 5000), (11, prose(rng, 60), None), (12, "A@b.cd 1.2.3.4"),
    ]
