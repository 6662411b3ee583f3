"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rest(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def jaccard_classes(docs, words=5, percent=75):
    """{doc_id: (set size, component)}."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    holders, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for o, n in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def lm_scores(docs, m2=100.0, m3=400.0):
    """{doc_id: (held out, tokens, known, train tokens, base, score)}."""
    uni, bi, tri, texts, seqs = Counter(), Counter(), Counter(), 0, {}
    for d, t in docs:
        s = ["<2", "<1", *WORD.findall(lower(t)), None]
        held = rest(d, 10) == 0
        seqs[d] = (s, held)
        if not held:
            texts += 1
            for i in range(2, len(s)):
                uni[s[i]] += 1
                bi[s[i - 1], s[i]] += 1
                tri[s[i - 2], s[i - 1], s[i]] += 1
    total, kinds, out = sum(uni.values()), len(uni), {}
    for d, (s, held) in seqs.items():
        base = score = known = 0
        for i in range(2, len(s)):
            p1 = (uni[s[i]] + 0.1) / (total + 0.1 * (kinds + 1))
            c1, c2 = (uni[s[i - 1]], bi[s[i - 2], s[i - 1]]) if i > 2 else (texts, texts)
            p2 = (bi[s[i - 1], s[i]] + m2 * p1) / (c1 + m2)
            p3 = (tri[s[i - 2], s[i - 1], s[i]] + m3 * p2) / (c2 + m3)
            base, score, known = base + math.log10(p1), score + math.log10(p3), known + (uni[s[i]] > 0)
        out[d] = (held, len(s) - 2, known, total, base, score)
    return out


def without_repeats(docs, length=50):
    """{doc_id: (bytes, removed, spans, kept bytes)}."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b, own = (t or "").encode(), set()
        gone, upto = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                a = max(i, upto)
                gone[a : i + length] = b"\1" * (i + length - a)
                upto = i + length
            own.add(w)
        seen |= own
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), kept)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def mix_targets(size, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing; ``size`` by source, None last."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(size.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * size[s]]
        if not over:
            for s in open_:
                target[s] = level * weight[s]
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
            open_.discard(s)
    return target
