"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    found = words((text or "").translate(_LOWER))
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + k]) for i in range(len(found) - k + 1)}


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    places = {}
    for i in range(len(found) - 7):
        places.setdefault(tuple(found[i:i + 8]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    n = len(found)
    return (n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def without_repeats(rows, window=20):
    """{doc_id: (n_words, n_removed, kept_text)} of (doc_id, text) rows with distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        found = words(text)
        for s in range(len(found) - window + 1):
            first.setdefault(tuple(found[s:s + window]), (i, s))
    for i, text in rows:
        found = words(text)
        gone = set()
        for s in range(len(found) - window + 1):
            if first[tuple(found[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(found), len(gone),
                  " ".join(w for j, w in enumerate(found) if j not in gone))
    return out
