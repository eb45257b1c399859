"""Small inputs and plain-Python forms shared by the tests."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, lang, source); n_chars is filled in."""
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def vocabulary(seed, n=400, letters="etaoinshrdlu"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


class Roots:
    """Union-find for the brute-force forms."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def __call__(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self(a), self(b)))
        self.up[b] = a
