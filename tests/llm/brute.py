"""Plain Python statements of what the corpus queries return."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

SPACES = " \t\n\x0b\f\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def passages(docs, window=50):
    """{(doc_id, text): (n_words, n_removed, kept)}; a null id is larger than all."""
    key = lambda i: float("inf") if i is None else i
    lowest = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            lowest[k] = min(lowest.get(k, key(i)), key(i))
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if lowest[tuple(w[p : p + window])] < key(i):
                gone.update(range(p, p + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i, text] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text):
    w = words(lower_ascii(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs):
    """{doc_id: (n_shingles, component_id)} for distinct non-null ids."""
    sets = {i: shingles(t) for i, t in docs}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in held[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edf(units, frame):
    """Order in which sources run: at each slot the released block that is due first."""
    given, order = {s: 0 for s in units}, []
    for t in range(frame):
        due = [(-(-(given[s] + 1) * frame // units[s]), s) for s in sorted(units) if given[s] < units[s] and given[s] * frame // units[s] <= t]
        s = min(due)[1]
        given[s] += 1
        order.append(s)
    return order


def pieces(ids, capacity):
    """(start, length, crc) of the pieces of a list of ids."""
    if len(ids) <= capacity:
        cuts = [0, len(ids)]
    else:
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
    data = b"".join(i.to_bytes(4, "little") for i in ids)
    return [(a, b - a, zlib.crc32(data[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def simhash(text):
    w = words(lower_ascii(text or ""))
    shingled = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(prints, within=4):
    """Component number of each fingerprint, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= within:
                parent[root(j)] = root(i)
    return [root(i) for i in range(len(prints))]


def runs(w):
    """(start, length, period) of all runs, trying every period from the smallest."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                found.setdefault((s, i - s + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """The row of op13 for one document."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    all_runs = runs(w)
    gone = {i for s, n, p in all_runs for i in range(s + p, s + n)}
    best = min(all_runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if all_runs else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in all_runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(all_runs), *best, 1000 * best[1] // best[2] if all_runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
