"""The contracts, said again in plain Python over a handful of rows."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 1 << 70


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def place(doc_id):
    return LAST if doc_id is None else doc_id


def jaccard_components(rows, percent=80, n=5):
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), LAST), place(d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if sets[i] else place(d)
        out.append((d, len(sets[i]), None if c == LAST else c))
    return sorted(out, key=repr)


def dedup_words(rows, n=13):
    firsts = {}
    words = [SPACED.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            firsts[k] = min(firsts.get(k, LAST + 1), place(d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if firsts[tuple(w[i : i + n])] < place(d):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def dedup_bytes(rows, n=100):
    firsts = {}
    texts = [(t or "").encode() for _, t in rows]
    for (d, _), b in zip(rows, texts):
        for i in range(len(b) - n + 1):
            k = b[i : i + n]
            firsts[k] = min(firsts.get(k, (LAST + 1, 0)), (place(d), i))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if firsts[b[i : i + n]] < (place(d), i):
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=repr)


def contamination(rows, items, n=13):
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for item, text in items:
            x = ALNUM.findall((text or "").translate(LOWER))
            size = min(n, len(x))
            for j in range(len(x) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == x[j : j + size]:
                        hit[i : i + size] = [True] * size
                        found.add(str(item))
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def top_scores(rows, every=20, k=20):
    import math

    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine[(i, tuple(v))] = [math.floor(64 * x) for x in v]
    out = []
    for (q, _), a in fine.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for (i, _), b in fine.items() if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def counts(rows):
    return Counter(rows)


def spelling(rows, min_length=6, min_count=5, times=5):
    import zlib

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    letters = sorted({c for w in counts for c in w})
    form, n_near = {}, {}
    for w, n in counts.items():
        cut = [w[:i] + w[i + 1 :] for i in range(len(w))]
        edits = set(cut) | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near = [x for x in edits if x != w and x in counts]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return sorted(out, key=repr)
