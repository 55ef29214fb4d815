"""The contracts computed document by document in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def near(rows, width=4, percent=80):
    """{doc_id: (n_shingles, component)} of rows with distinct ids."""
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for d, text in rows:
        w, hit, names = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    names |= {str(x) for x in windows[key] if x is not None}
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def passages(rows, width=13):
    least, words = {}, {}
    for n, (d, text) in enumerate(rows):
        words[n] = WORD.findall(text or "")
        for i in range(len(words[n]) - width + 1):
            key = tuple(words[n][i : i + width])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for n, (d, _) in enumerate(rows):
        w = words[n]
        gone = {i + k for i in range(len(w) - width + 1) if d is not None and least[tuple(w[i : i + width])] < d for k in range(width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if d is None or len(key(x)) < 10 or min(holders[key(x)]) == d]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out
