"""Plain versions of the operators, for small tables."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def least_linked(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def op2(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            else:
                seen.add(w)
        a = np.frombuffer(b, np.uint8)
        runs = np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)
        out[i] = (len(b), int(gone.sum()), int(runs), sha(a[~gone].tobytes()))
    return out


def op9(docs, length=13):
    first, out = {}, {}
    split = {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def op3(docs, k=3, percent=90):
    s = {i: shingles(t, k) for i, t in docs}
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] and s[b] and min(len(s[a]), len(s[b])) * 100 >= percent * max(len(s[a]), len(s[b])) and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    comp = least_linked(ids, links)
    return {i: (len(s[i]), comp[i]) for i in ids}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def line_dedup(docs, most=1, least_words=5):
    """Texts without the lines that go; None for texts that lose all."""
    places = {}
    for i, t in sorted(docs):
        for pos, line in enumerate((t or "").split("\n")):
            if t is not None and len(WORD.findall(line)) >= least_words:
                places.setdefault(line, []).append((i, pos))
    lines = sorted(places, key=len)
    links = []
    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if len(b) - len(a) > most:
                break
            if sum(x != y for x, y in zip(a[:20], b[:20])) > 3 and sum(x != y for x, y in zip(a[-20:], b[-20:])) > 3:
                continue
            if edits(a, b) <= most:
                links.append((a, b))
    comp = least_linked(lines, links)
    groups = {}
    for line, at in places.items():
        groups.setdefault(comp[line], []).extend(at)
    gone = {x for at in groups.values() for x in sorted(at)[1:]}
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = t
            continue
        kept = [line for pos, line in enumerate(t.split("\n")) if (i, pos) not in gone]
        out[i] = "\n".join(kept) if kept else None
    return out
