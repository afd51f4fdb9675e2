"""Plain versions of what the operators compute."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def near_components(docs, size, percent):
    """Component id of each row, by comparing all pairs of distinct sets."""
    sets = [shingles(t, size) for _, t, *_ in docs]
    of = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            of[s].append(i)
    classes = list(of)
    parent = list(range(len(classes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holding = defaultdict(list)
    for c, s in enumerate(classes):
        for w in s:
            holding[w].append(c)
    for c, s in enumerate(classes):
        common = defaultdict(int)
        for w in s:
            for d in holding[w]:
                if d > c:
                    common[d] += 1
        for d, n in common.items():
            if 100 * n >= percent * (len(s) + len(classes[d]) - n):
                parent[root(d)] = root(c)
    ids = defaultdict(list)
    for c, s in enumerate(classes):
        ids[root(c)] += [docs[i][0] for i in of[s] if docs[i][0] is not None]
    where = {i: c for c, s in enumerate(classes) for i in of[s]}
    return [min(ids[root(where[i])], default=None) if s else docs[i][0] for i, s in enumerate(sets)]
