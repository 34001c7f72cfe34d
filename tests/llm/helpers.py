"""Brute-force versions and small tables for the tests of issq.llm."""

import re
from collections import Counter

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
#: Nulls, empty and blank texts, ties, repeated rows, a long text.
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "some words that have no number at all here"), (4, "tie tie tie tie tie"), (5, "tie tie tie tie tie"), (5, "tie tie tie tie tie"),
    (6, "Ünïcode wörds: 漢字 and 👍 emoji, with <|endoftext|> inside; don't stop."), (7, "long " * 30_000), (8, "x"), (9, "Mixed CASE words, Mixed case WORDS!"),
]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall("[^\x20\x09-\x0d]+", lower(s))


def shingles(s):
    w = words(s)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def components(rows):
    """doc position -> smallest linked doc_id, by comparing every pair."""
    sets = [set(shingles(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(rows[i][0], len(sets[i]), least.get(find(i), rows[i][0])) for i in range(len(rows))]


def leaks(rows, items):
    out, wanted = {}, [(k, Counter(shingles(it))) for k, it in items]
    for d, t in rows:
        own = shingles(t)
        some = set(own)
        for k, want in wanted:
            if not some & want.keys():
                continue  # similarity 0
            size = sum(want.values())
            width = min(size, len(own))
            best = 0
            for s in range(len(own) - width + 1) if width else []:
                both = sum((Counter(own[s : s + width]) & want).values())
                best = max(best, both / (width + size - both))
            if best >= 0.75:
                out[d, k] = best
    return out
