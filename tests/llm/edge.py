"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) + rnd.choice("abcdefgh") for _ in range(n))


def texts(seed=3):
    rnd = random.Random(seed)
    base = [sentence(rnd, rnd.randint(20, 160)) for _ in range(12)]
    out = [None, "", "   \n\t ", "one", "two words", "Two WORDS", "é ß – „quoted“ 漢字 text", "x" * 3000, "ab " * 900,
           sentence(rnd, 20000)]
    for b in base:
        words = b.split(" ")
        near = list(words)
        near[len(near) // 2] = "changed"
        out += [b, b, " ".join(near), " ".join(words[: len(words) // 2]), b.upper()]
    shared = sentence(rnd, 90)
    out += [sentence(rnd, 30) + " " + shared + " " + sentence(rnd, 30) for _ in range(6)]
    return out


CLASH = ["row", "kept", "score", "lang_pred", "key", "a", "b", "bucket", "look", "_h", "th", "term", "n", "start", "length", "held_out", "spans", "_id"]


def documents(spark, rows=None):
    """documents with an extra column for each name an operator uses inside."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en" if i % 3 else ("fr" if i % 2 else None), "s", len(t) if t is not None else None, *(["c"] * len(CLASH)))
            for i, t in enumerate(rows)]
    if data:
        data += [data[-1], (None, data[-1][1], *data[-1][2:]), (None, None, *data[-1][2:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(data, schema).repartition(3)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
