"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def remove_repeats(rows, window=35):
    """(doc_id, n_words, n_removed, sha256 of the words left) of every (doc_id, text)."""
    starts = Counter()
    split = [(d, words(t)) for d, t in rows]
    for _, w in split:
        starts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_copies(rows, width=4, percent=80):
    """{doc_id: (set size, smallest linked doc_id)} by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by_shingle = {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    common = Counter()
    for members in by_shingle.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
