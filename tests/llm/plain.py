"""Brute-force versions of operators, for tests."""

from collections import Counter


def groups(fps, bits):
    """Smallest id of the group of each id; ids of fingerprints within ``bits`` are linked. Zero links too, but for
    deduplication its members stand alone."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def removed(texts, least):
    """What is left of each text's bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append(bytes(x for x, g in zip(d, gone, strict=True) if not g))
    return out


def shingles(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def benchmark_leaks(docs, items, k=5, least=0.8):
    """(doc, item) -> highest similarity of a window of the item's size, over all windows."""
    own = {i: t.lower().split() for i, t in items.items() if t and t.split()}
    bags = {i: Counter(shingles(w, min(k, len(w)))) for i, w in own.items()}
    out = {}
    for d, t in docs.items():
        words = (t or "").lower().split()
        for i, bag in bags.items():
            n, kk = len(own[i]), min(k, len(own[i]))
            all_of = shingles(words, kk)
            if not any(x in bag for x in set(all_of)):
                continue
            m = n - kk + 1
            for a in range(len(all_of)):
                win = Counter(all_of[a : a + m])
                o = sum((win & bag).values())
                s = o / (m + sum(win.values()) - o)
                if s >= least and s > out.get((d, i), 0):
                    out[d, i] = s
    return out
