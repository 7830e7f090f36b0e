"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import itertools
import re
import zlib

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(docs, k, percent=80):
    """{doc_id: (set size, component)}"""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeat_mask(docs, span=50):
    """{doc_id: (bytes, covered)}: the bytes that runs from smaller documents cover."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                covered[k : k + span] = b"\1" * span
        out[i] = b, covered
    return out


def repeats(docs, span=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    out = {}
    for i, (b, c) in repeat_mask(docs, span).items():
        kept = bytes(x for x, gone in zip(b, c) if not gone)
        out[i] = len(b), sum(c), sum(1 for k in range(len(b)) if c[k] and not (k and c[k - 1])), hashlib.sha256(kept).hexdigest()
    return out


def luhn(digits):
    double = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in zip(KINDS, PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def hard_negatives(rows, is_anchor, k=5, percent=80):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) of (id, label, whole numbers)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        near = sorted((-score(v, w), j, other) for j, other, w in rows if j != i)
        for p, j in [(-s, j) for s, j, other in near if other == label][:k]:
            inside = [(-s, n) for s, n, other in near if other != label and percent * p <= -100 * s <= 100 * p]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(inside[:k], 1)]
    return sorted(out)


def one_edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling(counts, ratio=10):
    """{word: (form, root, n, n_near, form_n)}"""
    forms, near = {}, {w: [v for v in counts if v != w and one_edit_apart(v, w)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = forms[w], root, counts[w], len(near[w]), counts.get(forms[w])
    return out


def counted_words(docs, least=7, often=2, one_in=31):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}
