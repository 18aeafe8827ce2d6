"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rules(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 20 or 100 * len(hit) > 30 * n,
    }


def exact(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    group = {}
    for i, t in norm.items():
        group.setdefault(t, []).append(i)
    return {i: (min(group[t]), len(group[t]), i == min(group[t]), sha(t)) for i, t in norm.items()}


def near(docs, k=5, share=85):
    sets = {}
    for i, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= share * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((top(x), top(y)))
                    at[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def runs(mask):
    return sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))


def suffix(docs, n=50):
    """docs: (id, text); returns id -> n_bytes, n_removed, n_spans, kept_sha256."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        mask = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                mask[p : p + n] = [True] * n
        out[i] = (len(b), sum(mask), runs(mask), sha(bytes(x for x, m in zip(b, mask) if not m)))
    return out


def substring(docs, n=35):
    seen = {}
    for _, t in docs:
        w = words(t)
        for p in range(len(w) - n + 1):
            s = tuple(w[p : p + n])
            seen[s] = seen.get(s, 0) + 1
    out = {}
    for i, t in docs:
        w = words(t)
        mask = [False] * len(w)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                mask[p : p + n] = [True] * n
        out[i] = (len(w), sum(mask), sha(" ".join(x for x, m in zip(w, mask) if not m)))
    return out
