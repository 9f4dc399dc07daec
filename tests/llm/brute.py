"""Plain Python versions of the operators' contracts, one text at a time."""

import collections
import hashlib
import re
import struct
import zlib

import xxhash

KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]",
              lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def luhn(digits):
    if not 14 <= len(digits) <= 19:
        return False
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def spans(text, kinds):
    found = []
    for number, (kind, (pattern, holds)) in enumerate(kinds.items()):
        found += [(m.start(), number, kind, m.end()) for m in re.finditer(pattern, text or "")
                  if holds(m)]
    found.sort()
    counts = collections.Counter(f[2] for f in found)
    return counts, [f"{kind}:{start}:{end}" for start, _, kind, end in found]


def sha(values):
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def contamination(texts, items, window=13):
    """(n_words, n_hit, items, contaminated) of each text; items are (id, text)."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))

    windows = collections.defaultdict(set)
    for item_id, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i:i + window])].add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    met |= {str(x) for x in found if x is not None}
        out.append((len(w), len(hit), sorted(met), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    if not words:
        return 0
    grams = [words[i:i + width] for i in range(len(words) - width + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(marks, distance=2):
    """The least row of each fingerprint's class, over all pairs."""
    least = {m: i for i, m in reversed(list(enumerate(marks)))}
    distinct = list(least)
    parent = {m: m for m in distinct}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    low = {}
    for m in distinct:
        low[root(m)] = min(low.get(root(m), least[m]), least[m])
    return [low[root(m)] for m in marks]


def rules(text, window=8):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    seen = collections.Counter(grams)
    repeated = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            repeated.update(range(i, i + window))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(repeated),
            len(words) < 20 or 100 * len(repeated) > 30 * len(words))


def pieces(ids, capacity=2048):
    """(start, ids) of each piece of a document's ids."""
    first = len(ids) % capacity if len(ids) > capacity else len(ids)
    out = [(0, ids[:first])] if first else []
    return out + [(i, ids[i:i + capacity]) for i in range(first, len(ids), capacity)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
