"""Plain, slow versions of the operators to compare with."""

import hashlib
import math
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def shingles(text):
    found = words((text or "").translate(UPPER))
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(zip(found, found[1:], found[2:], found[3:], found[4:], strict=False))


def components(texts):
    """{doc_id: (set size, component)} for {doc_id: text}, over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    common = Counter()
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality_counts(text):
    text = text or ""
    found = words(text)
    windows = Counter(zip(found, found[1:], found[2:], strict=False))
    covered = set()
    for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def binomial_allowed(n, risk, error):
    """Most rejections k with P(Bin(n, risk) <= k) <= error, by exact sums; None if not even 0."""
    total, best = 0.0, None
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > error:
            return best
        best = k
    return best


def edited(texts):
    """{doc_id: (n_chars, sha of the edited text)} for {doc_id: text}."""
    ids = sorted(texts)
    out = {}
    for at, i in enumerate(ids):
        mine, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        n = len(mine) // 4
        new = mine[: len(mine) - n] + following[:n]
        out[i] = (len(mine), hashlib.sha256(new.encode()).hexdigest())
    return out
