"""Plain versions that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def decontaminated(docs, items, window=10):
    """(words, hit words, items, digest, contaminated) of each text, in order."""
    windows = defaultdict(set)
    for item, text in items:
        words = alphanumeric(text)
        if item is None or not words:
            continue
        size = min(window, len(words))
        for j in range(len(words) - size + 1):
            windows[tuple(words[j : j + size])].add(str(item))
    sizes, out = {len(k) for k in windows}, []
    for text in docs:
        words, hit, found = alphanumeric(text), set(), set()
        for size in sizes:
            for j in range(len(words) - size + 1):
                names = windows.get(tuple(words[j : j + size]))
                if names:
                    hit |= set(range(j, j + size))
                    found |= names
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingle_set(text, words):
    found = spaced(text)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def similar(docs, words=3, percent=90):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {d: shingle_set(t, words) for d, t in docs}
    holders, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for g in s for e in holders[g])
        for e, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return sorted(found)
