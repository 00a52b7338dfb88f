"""Rows and plain Python versions that the tests of the training-data operators share."""

import re
from itertools import combinations

#: Names that the operators use inside.
NAMES = "id a b h n d x lo hi bucket component label word kept kept_of lines stay spans gone n_lines n_removed part rank length piece start norm sim minor block class v w c1".split()
LONG = " ".join(f"w{i * 7919 % 6007}" for i in range(6000))


def awkward(spark):
    """Nulls, empty, blank, short, very long and repeated texts, null and repeated ids, clashing names."""
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, LONG), (7, LONG), (7, LONG), (None, "no id here at all"), (None, None), (8, "é ß 漢字 🙂"), (9, "x" * 70_000)]
    rows = [(i, t, None if k % 2 else "en", None, k, *([k] * len(NAMES))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES))


def empty(spark):
    return awkward(spark).limit(0)


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def shingles(text):
    words = split(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(ids, linked):
    """The least id that each id reaches."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def near(texts):
    """Component of each document of {id: text} by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = []
    for a, b in combinations([i for i, s in sets.items() if s], 2):
        x, y = sets[a], sets[b]
        if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            links.append((a, b))
    return groups(texts, links)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]
