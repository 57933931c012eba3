"""Plain versions of the operators, one document or one pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    own = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words(text)]
    if not own:
        return frozenset()
    if len(own) < n:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1))


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rows, threshold=0.8):
    """{doc_id: (class_id, n_links)} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for ids in holders.values():
        ids.sort()
        common.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    links, pairs = Counter(), []
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    root = components(sets, pairs)
    return {d: (root[d], links[d]) for d in sets}


def rules(text):
    text, own = text or "", words(text)
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    inside = set()
    for i in range(len(own) - 7):
        if windows[tuple(own[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    filled = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": len(inside),
        "base_failed": len(own) < 20 or 100 * len(inside) > 30 * len(own),
    }


def later_chars(text, n):
    """Characters of words inside n-grams that the text has had before."""
    own, seen, inside = words(text), set(), set()
    for i in range(len(own) - n + 1):
        gram = tuple(own[i : i + n])
        if gram in seen:
            inside.update(range(i, i + n))
        seen.add(gram)
    return sum(len(own[i]) for i in inside)


PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def secrets(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    listed = [f"{kind}:{a}:{z}" for a, _, kind, z in sorted(found)]
    counts = Counter(kind for _, _, kind, _ in found)
    return [counts[k] for k in PATTERNS], hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url(text):
    m = re.search(r"://([^/?#]*)([^?#]*)", text or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def shared_lines(rows, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip("\t\n\x0b\x0c\r "))

    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
