"""Plain slow versions of the text operators, to compare with on small inputs."""

import hashlib
import re
from itertools import combinations

import numpy as np
import xxhash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def rank(doc_id, text, size):
    key = ("" if doc_id is None else str(doc_id)) + ":" + (text or "")
    u = (int(hashlib.md5(key.encode()).hexdigest()[:12], 16) + 0.5) / float(1 << 48)
    return u / (1 - u) / size


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """sizes: words by source. Shares what is above the capacity again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_, left = set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def mix(rows):
    """rows: (doc_id, text, source). Copies of each row."""
    size = [len(words_of(text)) for _, text, _ in rows]
    sizes = {}
    for n, (_, _, source) in zip(size, rows):
        sizes[source] = sizes.get(source, 0) + n
    target = targets(sizes)
    copies = [0] * len(rows)
    for source in sizes:
        own = [i for i, r in enumerate(rows) if r[2] == source and size[i]]
        if not own:
            continue
        whole = int(target[source] // sizes[source])
        missing = target[source] - whole * sizes[source]
        groups = {}
        for i in own:
            copies[i] = whole
            groups.setdefault(rank(rows[i][0], rows[i][1], size[i]), []).append(i)
        taken, chosen, open_ = 0, [], True
        rest = []
        for r in sorted(groups):
            n = sum(size[i] for i in groups[r])
            if open_ and taken + n <= missing:
                taken += n
                chosen += groups[r]
            else:
                open_ = False
                rest.append(r)
        left = missing - taken
        fits = [(abs(size[groups[r][0]] - left), r) for r in rest]
        fits = [f for f in fits if f[0] < left]
        if fits:
            chosen += groups[min(fits)[1]]
        for i in chosen:
            copies[i] += 1
    return copies


# --- lines


def repeated_lines(texts, min_words=50):
    """texts in order. For each, the set of numbers of lines in runs that stand before."""
    seen, cut, docs = set(), [], []
    for text in texts:
        lines = [line.strip() for line in (text or "").split("\n")]
        at = [i for i, line in enumerate(lines) if words_of(line)]
        docs.append((at, [lines[i] for i in at], len(lines)))
        cut.append(set())
        solid = docs[-1][1]
        for a in range(len(solid)):
            total = 0
            for b in range(a + 1, len(solid) + 1):
                total += len(words_of(solid[b - 1]))
                if total >= min_words:
                    run = tuple(solid[a:b])
                    if run in seen:
                        cut[-1].update(range(a, b))
                    seen.add(run)
    # Lines without words go with the lines that are cut on both sides of them.
    return [
        {
            n
            for i in solid
            for n in range(at[i], at[i + 1] if i + 1 in solid else at[i] + 1)
        }
        for solid, (at, _, _) in zip(cut, docs)
    ]


def without_lines(text, numbers):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)


# --- SimHash


def fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, distance=4):
    """The smallest id reachable from each row."""
    root = {p: p for p in set(prints)}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        r = find(p)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(p)) for p in prints]


# --- benchmark


def folded_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(text, items, n=10):
    """items: (item_id, text). Words, the indices hit, the items found."""
    words, hit, found = folded_words(text), set(), set()
    for item_id, item in items:
        other = folded_words(item)
        size = min(n, len(other))
        if not size:
            continue
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("null" if item_id is None else str(item_id))
    return words, hit, sorted(found)


# --- neighbours


def nearest(rows, query, k):
    """rows: (vec_id, vector). The k best of every query row, in order."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = []
    for i, v in rows:
        if not query(i):
            continue
        scored = sorted((-float((v * w).sum()), j) for j, w in rows if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out
