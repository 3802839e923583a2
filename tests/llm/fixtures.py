"""Documents with every awkward case, and a table whose further columns clash with the operators' own names."""

import random

SCHEMA = "rk string, doc_id long, text string, lang string, source string, n_chars long, score double, lines array<string>, spans int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def texts():
    r = random.Random(5)
    base = prose(r, 160)
    out = [(i, prose(r, r.randint(12, 60)) + "\n" + prose(r, r.randint(5, 30))) for i in range(30)]
    out += [(40, base), (41, base), (42, base.replace("alpha", "alpna", 1)), (43, prose(r, 20) + "\n" + base + "\n" + prose(r, 20))]
    out += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "x" * 5000), (55, "ab " * 900), (56, prose(r, 3000)), (57, "é漢🙂 ▁ </s>[INST] <|endoftext|>\n" * 9), (None, prose(r, 70))]
    out += [(60, prose(r, 90))] * 2 + [(61, "a line that is repeated here\na line that is repeated here\na line that is repeated hers")]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([("k", i, t, "en", "s", len(t or ""), 0.5, ["x"], 3) for i, t in rows], SCHEMA)
