"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def smallest_linked(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows):
    """{id: (set size, component)} of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    linked = []
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x] if j > i)
        linked += [(i, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    comp = smallest_linked(sets, linked)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def contamination(docs, items):
    """{id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i:i + size])].add(item)
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                k = tuple(w[a:a + size])
                if k in windows:
                    hit.update(range(a, a + size))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def substrings(rows, size=50):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} of (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone, own = bytearray(len(b)), []
        for k in range(len(b) - size + 1):
            w = b[k:k + size]
            if w in seen:
                gone[k:k + size] = b"\1" * size
            own.append(w)
        seen.update(own)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def repeated_passages(rows, words=50):
    """{id: numbers of the lines} in runs of over ``words`` words of which an earlier
    document, or the same one before the run, holds a copy; rows of distinct ids."""
    seen, out = {}, collections.defaultdict(set)
    for i, text in sorted((r for r in rows if r[1] is not None)):
        lines = text.split("\n")
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                # longer runs are unions of these, as they hold one from each edge
                if sum(counts[a:b + 1]) > words:
                    first = seen.setdefault("\n".join(lines[a:b + 1]), (i, b))
                    if counts[a] and counts[b] and (first[0] != i or a > first[1]):
                        out[i].update(range(a, b + 1))
                if sum(counts[a:b + 1]) > 4 * words:
                    break
    return out
