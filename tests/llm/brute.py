"""Plain-Python versions of the operators' contracts, quadratic where need be."""

import hashlib
import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    """Words of op4."""
    return WORD.findall((text or "").encode().lower())


def shingles(text, k=5):
    """Runs of k words, all words where there are fewer."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def contamination(docs, items):
    """docs, items: (id, text) pairs -> rows of op4."""
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").encode().lower())
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = sorted({len(x) for x in windows})
    for doc, text in docs:
        w = WORD.findall((text or "").encode().lower())
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= x
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def secrets(text):
    """(n_assign, n_access, n_hex, written base spans) of op7."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = [k for _, k, _ in found]
    return *(kinds.count(k) for k in range(3)), ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def components(ids, linked):
    """Smallest id reachable from each of ids, given linked(i, j) on places."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def fingerprint(text, k=3):
    import xxhash

    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
