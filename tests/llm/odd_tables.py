"""A small table with everything that may be odd, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `bucket` int, `key` string, `block` long"

_rng = random.Random(5)
_vocabulary = ["".join(_rng.choices("abcdefghij", k=_rng.randint(2, 7))) for _ in range(300)]


def prose(words: int, rng=_rng) -> str:
    return " ".join(rng.choice(_vocabulary) for _ in range(words))


def odd_rows():
    passage = prose(70)
    base = prose(120)
    edited = base.split()
    edited[60] = "changed"
    texts = {
        0: base,
        1: base,
        2: " ".join(edited),
        3: prose(40) + " " + passage + " " + prose(30),
        4: None,
        5: "",
        6: passage + "\n" + prose(20),
        7: "  \t\n ",
        8: "é漢字ñ " * 40,
        9: "é漢字ñ " * 41,
        10: "a" * 3000,
        11: "a" * 2999 + "b",
        12: "one two",
        13: "ONE two",
        14: prose(6000) + " " + passage,
        15: "Mail bob@mail.example.com or 10.0.0.1, 4539 1488 0343 6467, +1 (555) 010-9999 now",
        16: "Mail bob@mail.example.com or 300.0.0.1 soon",
        17: "12 34 !!! ???",
        18: "x " * 200,
        19: "x " * 180 + prose(3),
        20: "w1 w2 w3 w4 w5 w6 w7 w8",
        21: "w1 w2 w3 w4 w5 w6 w7 w9",
        22: "w1 w2 w3 w4 w5 w6 w7 w8 w9",
    }
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 2}", len(t or ""), 7, "k", 3) for k, t in texts.items()]
    rows.append(rows[3])  # a repeated row
    rows.append((6, "another text under a known id " + passage, None, None, None, None, None, None))
    rows.append((None, base, "en", "s0", 1, 1, "k", 1))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def random_rows(n: int, seed: int):
    """Texts that share passages and near copies of one another."""
    rng = random.Random(seed)
    shared = [prose(rng.randint(45, 90), rng) for _ in range(6)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(_vocabulary)
            texts.append(" ".join(words))
        else:
            parts = [prose(rng.randint(1, 80), rng)]
            if kind < 0.6:
                parts.insert(rng.randint(0, 1), rng.choice(shared))
            texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return [(i, t, "en", "s", len(t), 0, "k", 0) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def removed_windows(rows, tokens, window=50):
    """For every row with an id: its tokens and whether each one goes."""
    first = {}
    split = [(i, tokens(t or "")) for i, t, *_ in rows]
    for i, x in split:
        if i is not None:
            for s in range(len(x) - window + 1):
                key = tuple(x[s : s + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, x in split:
        gone = [False] * len(x)
        if i is not None:
            for s in range(len(x) - window + 1):
                if first[tuple(x[s : s + window])] < i:
                    gone[s : s + window] = [True] * window
        out.append((i, x, gone))
    return out


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", words) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(rows):
    """Size and smallest reachable id of every row with an id, over all pairs."""
    named = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            (i, x), (j, y) = named[a], named[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return sorted((i, len(x), find(i)) for i, x in named)
