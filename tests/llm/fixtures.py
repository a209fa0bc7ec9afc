"""Small documents with every odd case: nulls, empty and long texts, copies, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id int, key string, fp string, pos int, word string, start string, score string, kept string, n_words string, band int, spans int, _x int"


def words(g, n):
    return " ".join("".join(g.choice(["th", "en", "er", "ing", "on", "re", "st", "éa", "in", "ou"]) for _ in range(g.randint(1, 4))) for _ in range(n))


def texts():
    g = random.Random(4)
    base = [words(g, 120) for _ in range(6)]
    passage = words(g, 90)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10, base[0]), (11, base[0].replace(" ", "\n")), (12, base[0] + "  "), (13, base[1].upper()), (14, base[1] + " tail"), (15, words(g, 40) + " " + passage + " " + words(g, 30)), (16, passage + words(g, 50))]
    out += [(20, ""), (21, None), (22, "   \n\t"), (23, "a"), (24, "one two"), (25, "Σίγμας ΟΔΟΣ İstanbul don't we'll <|endoftext|> x y"), (26, "1234 5678 !!"), (27, "ab" * 900), (28, words(g, 30000))]
    out += [(30, "\n".join([words(g, 12) for _ in range(6)] + ["short", ""])), (31, None)]
    out += [(31, base[2]), (31, base[2]), (5, base[5]), (None, base[3]), (None, None), (-7, base[4] + "!")]
    lines = out[[d for d, _ in out].index(30)][1].split("\n")
    out.append((32, "\n".join([lines[2], "x" + lines[3][1:], lines[5] + ".", words(g, 9)])))
    return out


def frame(spark, rows=None, schema=SCHEMA):
    rows = texts() if rows is None else rows
    langs = ["en", "fr", None]
    full = [(d, t, langs[i % 3], f"src{i % 4}", None if t is None else len(t)) + (None,) * 13 for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame([r[:18] for r in full], schema).repartition(3)


def empty(spark):
    return frame(spark, [])
