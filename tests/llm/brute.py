"""Plain versions of the operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return WORD.findall(lower(text))


def runs(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def classes(rows, threshold=0.8):
    """{doc_id: smallest doc_id of its class} by comparing all pairs that share a run."""
    bags = {d: runs(t) for d, t in rows}
    head = {d: d for d, _ in rows}

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)

    index, empty = defaultdict(list), {}
    for d, t in rows:
        if not bags[d]:
            join(d, empty.setdefault(t or "", d))
        for r in bags[d]:
            index[r].append(d)
    seen = set()
    for of in index.values():
        for i, a in enumerate(of):
            for b in of[:i]:
                if (a, b) not in seen and find(a) != find(b):
                    seen.add((a, b))
                    both = sum((bags[a] & bags[b]).values())
                    if both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-12:
                        join(a, b)
    return {d: find(d) for d, _ in rows}
