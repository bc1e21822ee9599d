"""Documents with every awkward case, and plain versions of shared rules."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, h long, fp long, _q string, did string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(r, n, lines=1):
    pick = lambda: r.choice(("the", "of", "and", "to", "in", "that", "is", "was")) if r.random() < 0.4 else "".join(r.choice(("an", "er", "ing", "th", "on", "ti", "re", "ou")) for _ in range(r.randint(1, 5)))
    return "\n".join(" ".join(pick() for _ in range(n // lines)) + "." for _ in range(lines))


def awkward(spark, seed=1):
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, columns that clash with inner names."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 300), r.randint(1, 5)) for _ in range(40)]
    texts += [texts[0], texts[1] + "  ", " " + texts[2], texts[3].upper(), texts[4].replace(" ", "\t"), texts[5] + " tail", texts[6].replace("the", "The", 1)]
    texts += ["", None, " ", "\n\n", "one", "\u00e9t\u00e9 \u65e5\u672c \u00a0 x", "a b c d", "a b c d", prose(r, 12000, 40), "word " * 5000, "x" * 30000]
    rows = [(i, t, r.choice(("en", "de", None, "zz")), r.choice(("src0", "src0", "src5", None, "odd")), None if i % 7 == 0 else len(t or ""), "n", i, i, "q", "d") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], "en", "src0", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
