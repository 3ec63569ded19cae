"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict
from math import log

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items, width=13):
    """(doc_id, n_words, n_hit, items) of each (doc_id, text)."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    holders = defaultdict(set)
    for item, text in items:
        w = re.findall(pattern, (text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            holders[tuple(w[i : i + width])].add(str(item))
    sizes = sorted({len(k) for k in holders})
    out = []
    for doc, text in docs:
        w = re.findall(pattern, (text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := holders.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def dedup_lines(docs, min_chars=10):
    """(doc_id, n_lines, n_dropped, kept text) of each (doc_id, text)."""
    last = 2**63 - 1
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACE).translate(LOWER)].add(last if doc is None else doc)
    out = []
    for doc, text in docs:
        own, lines = last if doc is None else doc, (text or "").split("\n")
        keys = [x.strip(SPACE).translate(LOWER) for x in lines]
        kept = [
            x
            for x, k in zip(lines, keys, strict=True)
            if len(k) < min_chars or min(holders[k]) == own
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_counts(text: str | None):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gram_buckets(text: str | None, buckets: int) -> list[int]:
    """Buckets of a text's words and pairs of neighbouring words."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    pairs = [
        xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))
        for a, b in zip(h, h[1:], strict=False)
    ]
    return [_signed(x) % buckets for x in h + pairs]


def quality(docs, labels, buckets, tail):
    """doc row number -> (score, kept) with every labelled document in the sample."""
    quality_of = {}
    for doc, label in labels:
        if doc is not None and label is not None:
            quality_of[doc] = min(label, quality_of.get(doc, label))
    grams = [gram_buckets(t, buckets) for _, t in docs]
    raw, trusted = Counter(), Counter()
    for (doc, _), own in zip(docs, grams, strict=True):
        raw.update(own)
        if quality_of.get(doc) == 1:
            trusted.update(own)
    n, t = sum(raw.values()), sum(trusted.values())
    ratio = [
        log((trusted[b] + 1) / (t + buckets)) - log((raw[b] + 1) / (n + buckets)) for b in range(buckets)
    ]
    scores = [sum(ratio[b] for b in own) / len(own) if own else None for own in grams]

    def percentile(values, p):
        values = sorted(values)
        at = p * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (at - low)

    ends = []
    for label, p in ((1, tail), (0, 1 - tail)):
        own = [
            s for (d, _), s in zip(docs, scores, strict=True) if quality_of.get(d) == label and s is not None
        ]
        if own:
            ends.append(percentile(own, p))
    threshold = sum(ends) / len(ends) if ends else 0.0
    out = []
    for (_, text), score in zip(docs, scores, strict=True):
        n_words, _, _, _, repeats = base_counts(text)
        failed = n_words < 20 or 100 * repeats > 30 * n_words
        out.append((score, not failed and (score is None or not t or score >= threshold)))
    return out


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[i:] for i in range(width)], strict=False))


def components(docs, percent=75, width=5):
    """(doc_id, set size, component) of each (doc_id, text); all pairs are compared."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, (doc, _) in enumerate(docs):
        parent[find(i)] = find(first.setdefault(doc, i))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b) if a and b else 0
            if same and 100 * same >= percent * (len(a) + len(b) - same):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        known = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(docs)]
