"""Small document tables with everything that may go wrong: nulls, empty and very long texts, repeated rows, odd columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp int, size int, copies int"


def prose(seed, words, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def docs(spark, texts, source=None, lang=None):
    """Documents numbered from 0; columns named like the operators' own come along."""
    rows = [(k, t, (lang or {}).get(k, "en"), (source or {}).get(k, f"s{k % 3}"), len(t or ""), "x", 1, 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    long = prose(1, 30_000)
    rows = [
        (1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n", "fr", "b"), (None, "no id here", "en", None),
        (5, long, "en", "a"), (6, long, "en", "a"), (7, "ÄÖÜ ß 日本語 İ", "de", "\U0001f600"), (8, "12 34 !?", None, "a"), (9, "x" * 100_000, "en", "c"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, 0, "x", 1, 2, 3) for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def components_of(nodes, links):
    """Smallest node reachable, by repeated lowering."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least
