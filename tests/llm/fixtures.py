"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, tag int, component_id string, runs int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def vocabulary(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeghiklmnoprstuvwéñß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def texts(n, seed, length=60):
    rng, vocab = random.Random(seed), vocabulary()
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(length // 2, length * 2))) for _ in range(n)]


def rows(seed=5, n=40):
    """(doc_id, text, lang, source) with copies, near copies, shared passages and odd rows."""
    rng, out = random.Random(seed), []
    base = texts(n, seed)
    passage = texts(1, seed + 1, 30)[0]
    for i, t in enumerate(base):
        kind = i % 8
        if kind == 1:
            t = base[i - 1]
        elif kind == 2:
            w = base[i - 2].split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = t + "\n\n " + passage + " " + base[0][:100]
        elif kind == 4:
            t = t.upper() if i % 16 == 4 else t + " " + t
        out.append((i * 3 + 1, t, ("en", "de", None)[i % 3], (None if i == 7 else f"src{i % 4}")))
    long = " ".join(texts(60, seed + 2))
    out += [(1000, None, "en", "src0"), (1001, "", "en", "src0"), (1002, " \n\t ", None, "src1"), (1003, "one two", "en", "src1"), (1004, "One two", "en", None),
            (1005, long, "fr", "src0"), (1006, long + " more", "fr", "src0"), (None, base[3], "en", "src1"), (None, "alone here", "en", "src1"),
            (1007, base[4], "en", "src0"), (1007, base[4], "en", "src0"), (1008, base[5], "en", "src2"), (1008, base[6], "en", "src2"),
            (1009, "a b nbsp wide  tab\tx\x0by \x1f z", "en", "src3")]
    return out


def frame(spark, data):
    """A table with further columns whose names an operator might use itself."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "x", 4) for r in data], COLUMNS).repartition(3)
