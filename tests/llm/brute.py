"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math

WS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def drop_lines(rows, min_chars=40, min_docs=5):
    """``(n_lines, n_dropped, kept text)`` of every ``(doc_id, text)``."""
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := line_key(x)) >= min_chars:
                holders[k].add(i)
    keeper = {k: max(v, key=lambda x: (x is not None, x)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in keeper or keeper[line_key(x)] == i]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def drop_passages(rows, span=13):
    """``(n_words, n_removed, kept)`` of every row; ids must not be null."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - span + 1):
            p = tuple(w[k:k + span])
            least[p] = min(least.get(p, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if least[tuple(w[k:k + span])] < i:
                gone[k:k + span] = [True] * span
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def drop_strings(texts, span):
    """``(n_bytes, n_removed, n_spans, kept)`` of every text."""
    coded = [(t or "").encode() for t in texts]
    count = collections.Counter(b[k:k + span] for b in coded for k in range(len(b) - span + 1))
    out = []
    for b in coded:
        gone = [False] * len(b)
        for k in range(len(b) - span + 1):
            if count[b[k:k + span]] > 1:
                gone[k:k + span] = [True] * span
        runs = sum(1 for q, g in enumerate(gone) if g and (q == 0 or not gone[q - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingle_sets(texts):
    """Shingle -> weight of every text, with word weights over these texts, like the operator's but without hashing."""
    n = sum(bool(words(t)) for t in texts)
    df = collections.Counter(w for t in texts for w in set(words(t)))
    weight = {w: math.log1p(n / c) / math.log1p(n) for w, c in df.items()}
    out = []
    for t in texts:
        w, seen, own = words(t), collections.Counter(), {}
        for k in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[k:k + 5])
            own[(s, seen[s])] = sum(weight[x] for x in s) / len(s)
            seen[s] += 1
        out.append(own)
    return out


def similarity(a, b):
    shared = sum(v for k, v in a.items() if k in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def labels(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_classes(rows, threshold=0.8):
    sets = shingle_sets([t for _, t in rows])
    ids = [i for i, _ in rows]
    return labels(ids, [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if similarity(sets[a], sets[b]) >= threshold])


def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        new = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (pattern[i - 1] != text[j - 1]))
        row = new
    return min(row)
