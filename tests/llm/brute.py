"""Plain Python versions of operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

BLANKS = " \t\r\x0b\x0c"


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(links, ids)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def line_dedup(docs, min_words):
    """Text after deletion of every run of lines that has occurred before; runs of any length are compared."""
    seen, out = {}, {}
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").split("\n")
        at = [k for k, line in enumerate(raw) if line.strip(BLANKS)]
        lines = [raw[k].strip(BLANKS) for k in at]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(re.split("[ \t\r\x0b\x0c]+", x)) for x in lines[i:j]) >= min_words and seen.setdefault(tuple(lines[i:j]), (d, i)) != (d, i):
                    gone.update(range(i, j))
        dropped = {at[i] for i in gone} | {k for i in gone if i + 1 in gone for k in range(at[i], at[i + 1])}
        out[d] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in dropped) if gone else text)
    return out


def mix(docs, weights=(1, 2, 3), epochs=3):
    """Target and size of each source; the excess is shared anew, round by round."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        for s in full or open_:
            target[s] = epochs * sizes[s] if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return {s: (sizes[s], target[s]) for s in order}


def prefix_trie(rows, every=5, modulus=9):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % modulus
        rest = abs(c) % every
        whole[c] = own.get(c - rest if c >= 0 else c + rest, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    ends = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[node] if len(whole[c]) == len(node))).encode()).hexdigest()
    return [(min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], ends(n)) for n, who in members.items()]


def divergence(docs, min_docs=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
    counts, having, groups = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for text, lang, source in docs:
        key = (lang or "", source or "")
        groups[key[0]].add(key[1])
        for w in words(text):
            counts[key][w] += 1
        for w in set(words(text)):
            having[key[0]][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in having[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (count[w] + 1) // total for w in kept}

        whole = shares(defaultdict(int, {w: sum(counts[lang, s][w] for s in sources) for w in kept}))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - whole[w]) ** 2 // whole[w], w) for w in kept if counts[lang, s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return out
