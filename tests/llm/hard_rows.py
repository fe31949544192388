"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, "
          "key string, hit int, items string, lines int, carried string, score string, "
          "tile int, component_id string, n_words string, places string, hash string")


def texts() -> list[tuple[int | None, str | None]]:
    draw = random.Random(5)
    syllables = "an be co du el fi ga ho in jo ku la mi no".split()

    def words(n):
        return ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(n)]

    base = words(160)
    passage = words(60)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "One"), (6, "two words"),
        (7, "Ärger über Öl — 12% ... İstanbul ﬁn"), (8, "漢字 かな 한글 🎈🎈 漢字"),
        (None, "no id " * 30), (None, None), (9, "x" * 3000), (10, "same " * 700),
        (11, "same " * 650), (12, "\x0b\x0c\r\x1c\x85 a b  c"),
    ]
    for i in range(12):
        copy = list(base)
        for at in draw.sample(range(len(copy)), i // 3):
            copy[at] = "edit" + str(i)
        out.append((20 + i, " ".join(copy)))
    for i in range(6):
        own = words(70)
        out.append((40 + i, " ".join(own[:35] + passage + own[35:])))
    shared = ["  A line that SEVERAL documents have\t", "short", "another shared line here"]
    for i in range(6):
        own = [" ".join(words(5)) for _ in range(3)]
        out.append((60 + i, "\n".join([shared[i % 3], own[0], "", shared[0], own[1].upper(),
                                       shared[i % 3].upper(), own[2]])))
    out += [(80, "\n".join(["repeated inside one document"] * 4)),
            (81, " ".join(words(2000)) + "\n" + " ".join(base))]
    out += [(20, " ".join(base)), (40, "an other text under a used id")]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    draw = random.Random(1)
    filled = [(i, t, draw.choice(["en", "de", None]), "s", 7, 1, "k", 0, "i", 3, "c", "sc",
               4, "cc", "w", "p", "h") for i, t in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)
