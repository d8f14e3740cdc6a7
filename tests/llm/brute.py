"""Plain versions of the operators, row by row, for small inputs."""

import collections
import hashlib
import math
import zlib

import regex
import xxhash


def words(text):
    return (text or "").encode().split()


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    low = {}
    for root, (d, _) in zip(roots, rows, strict=True):
        low[root] = min((x for x in (low.get(root), d) if x is not None), default=None)
    return [(d, f"{p:016x}", low[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True)]


def substring(rows, window=35):
    seen = collections.Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def near(a, b):
    """Whether two word tuples are at most one word edit apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def lines(rows, protect=5, edit_words=5):
    """(doc, line, keep doc, keep line, edits) of the lines that go: an earlier line that stays is equal or one edit away."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    stays, known, out = [], {}, []
    for d, t in docs:
        for p, line in enumerate(t.split("\n")):
            w = tuple(words(line))
            if not w:
                continue
            if w not in known:
                earlier = [x[:2] for x in stays if near(x[2], w)] if len(w) >= edit_words else []
                known[w] = (*earlier[0], 1) if earlier else (d, p, 0)
                if not earlier:
                    if len(w) >= edit_words:
                        stays.append((d, p, w))
                    continue
            if len(w) >= protect:
                out.append((d, p, *known[w]))
    return out


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [x * (1 + i % 2) for i, x in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return True


def personal(rows):
    out = []
    for d, t in rows:
        counts, spans = [], []
        for kind, pattern in PATTERNS:
            found = [(kind, m.start(), m.end()) for m in regex.finditer(pattern, t or "") if _valid(kind, m.group())]
            counts.append(len(found))
            spans += found
        out.append((d, *counts, hashlib.sha256(",".join("%s:%d:%d" % x for x in spans).encode()).hexdigest()))
    return out


def measures(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = words(t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = [False] * len(w)
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                twice[i : i + 3] = [True] * 3
        full = [x for x in t.split("\n") if x.encode().split()]
        n, r = len(w), sum(twice)
        out.append((d, n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), r, n < 50 or 100 * r > 50 * n))
    return out


def lm_base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    seen = collections.Counter()
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    for (d, _), tk in zip(rows, tokens, strict=True):
        if not held(d):
            seen.update(tk)
    n, v = sum(seen.values()), len(seen)
    return [(d, held(d), len(tk), sum(seen[x] > 0 for x in tk), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in tk)) for (d, _), tk in zip(rows, tokens, strict=True)]


def suffix_tree(rows, min_context, min_next, discount=0.5):
    """Scores by a plain suffix tree, and the sum of each retained state's distribution."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [tk for (d, _), tk in zip(rows, tokens, strict=True) if not held(d)]
    words = collections.Counter(w for tk in train for w in tk)
    n, v = sum(words.values()), len(words)
    root = lambda w: (words[w] + 1) / (n + v + 1)
    states = {}

    def p(context, w):
        while context:
            if context in states:
                q, backoff = states[context]
                return q[w] if w in q else backoff * p(context[1:], w)
            context = context[1:]
        return root(w)

    plain = {(): {w: c / n for w, c in words.items()}}
    depth = 0
    while True:
        depth += 1
        counts = collections.Counter(tuple(tk[i - depth : i + 1]) for tk in train for i in range(depth, len(tk)))
        total = collections.Counter()
        for run, c in counts.items():
            total[run[:-1]] += c
        kept = {}
        for context in [c for c, k in total.items() if k >= min_context]:
            if depth > 1 and context[1:] not in states:
                continue
            nc = total[context]
            near = {run[-1]: c for run, c in counts.items() if run[:-1] == context and c >= min_next}
            if not near:
                continue
            below = plain[context[1:]]
            plain[context] = {w: c / nc for w, c in near.items()}
            share, other = sum(near.values()) / nc, min(1.0, sum(below[w] for w in near))
            rest, rest_below = max(1 - share, 1e-12), max(1 - other, 1e-12)
            kl = sum(c / nc * math.log(c / nc / below[w]) for w, c in near.items()) + rest * math.log(rest / rest_below)
            if 2 * nc * kl > len(near) * math.log(nc) + 10:
                q = {w: (c - discount) / nc for w, c in near.items()}
                kept[context] = (q, max(1 - sum(q.values()), 1e-12) / max(1 - sum(p(context[1:], w) for w in near), 1e-12))
        if not kept:
            break
        states |= kept
    sums = {(len(c), c): sum(p(c, w) for w in words) + math.prod(states[c[i:]][1] for i in range(len(c)) if c[i:] in states) / (n + v + 1) for c in states}
    scores = [(d, len(tk), sum(math.log10(p(tuple(tk[max(0, i - depth) : i]), w)) for i, w in enumerate(tk))) for (d, _), tk in zip(rows, tokens, strict=True)]
    return {"scores": scores, "states": sums}


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


def best_passage(item, text):
    """Fewest edits between an item and any passage of a text."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def jaccard_groups(rows, size=5, similarity=0.8):
    """Smallest doc_id of each row's group."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    roots = components(len(rows), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]))
    return [min(rows[j][0] for j in range(len(rows)) if roots[j] == r) for r in roots]
