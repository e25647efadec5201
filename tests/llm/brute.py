"""The contracts word by word, in plain Python over small tables."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = float("inf")


def ident(x):
    return LAST if x is None else x


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(lambda: LAST)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], ident(doc))
    return [(doc, f"{prints[i]:016x}", None if least[find(i)] == LAST else least[find(i)]) for i, (doc, _) in enumerate(rows)]


def without_repeats(rows):
    least = {}
    texts = [(ident(d), WORD.findall(t or "")) for d, t in rows]
    for doc, words in texts:
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            least[key] = min(doc, least.get(key, LAST))
    out = []
    for (doc, _), (order, words) in zip(rows, texts):
        gone = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < order:
                gone.update(range(i, i + 50))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, open_, done = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not above:
            return done | {s: rest * weight[s] / total for s in open_}
        for s in above:
            done[s] = 2.0 * sizes[s]
        rest -= sum(done[s] for s in above)
        open_ -= above
    return done


def counted(rows):
    return Counter(map(tuple, rows))
