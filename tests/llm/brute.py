"""Plain restatements of the operators' contracts."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    w = words((text or "").translate(_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def least_of_component(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_groups(texts, size, percent=80):
    """id → smallest id of its group, by comparing all sets."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    held = defaultdict(list)
    links = []
    for i in sorted(sets):
        both = Counter()
        for g in sets[i]:
            both.update(held[g])
            held[g].append(i)
        links += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    return sets, least_of_component(sets, links)


def base_counts(text):
    w, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated))


def repeated_spans(texts, size=50):
    """(id, first word, last word + 1, held by an earlier document)."""
    first, last, of = {}, {}, {i: words(t) for i, t in texts.items()}
    for i in sorted(of):
        for k in range(len(of[i]) - size + 1):
            g = tuple(of[i][k:k + size])
            first.setdefault(g, i)
            last[g] = i
    out = set()
    for i, w in of.items():
        for removed in (True, False):
            span = None
            for k in range(len(w) - size + 1):
                g = tuple(w[k:k + size])
                if first[g] == last[g] or (first[g] < i) != removed:
                    continue
                if span and k - span[1] <= size:
                    span[1] = k
                else:
                    if span:
                        out.add((i, span[0], span[1] + size, removed))
                    span = [k, k]
            if span:
                out.add((i, span[0], span[1] + size, removed))
    return out
