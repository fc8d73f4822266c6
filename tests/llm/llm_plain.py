"""Plain reference implementations and fixtures."""

import hashlib
import re
from collections import defaultdict

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)


def root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def joined(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = root(parent, a), root(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: root(parent, i) for i in ids}


def shingle_set(text, k):
    w = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_plain(texts, k, num, den):
    sets = [shingle_set(t, k) for t in texts]
    where, links = defaultdict(list), []
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                both[j] += 1
            where[x].append(i)
        links += [(i, j) for j, n in both.items() if den * n >= num * (len(s) + len(sets[j]) - n)]
    comp = joined(range(len(texts)), links)
    return {(i, len(s), comp[i]) for i, s in enumerate(sets)}


def near_copies(seed, groups=60):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 12, 20, 45, 120, 400]))
        base = rng.integers(0, 4000, n).tolist()
        for _ in range(int(rng.integers(1, 22))):
            w = list(base)
            for _ in range(int(rng.integers(0, 2 + n // 25))):
                w[int(rng.integers(0, n))] = int(rng.integers(0, 4000))
            out.append(" ".join(f"w{x}" if rng.random() > 0.1 else f"W{x}" for x in w))
    return out + [None, "", " \t\n", "a", "a"]


def removed_plain(texts, span=100):
    first, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for j in range(len(b) - span + 1):
            w = b[j : j + span]
            if w in first:
                edge[j] += 1
                edge[j + span] -= 1
            first.add(w)
        cut = np.cumsum(edge[:-1]) > 0
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum())
        out[i] = (i, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest())
    return out


def repeated_texts(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh éß"), int(rng.integers(1, 9)))) for _ in range(300)]
    passages = [" ".join(rng.choice(words, int(rng.integers(10, 80)))) for _ in range(15)]
    out = []
    for _ in range(250):
        s = " ".join(rng.choice(words, int(rng.integers(0, 150))))
        for _ in range(int(rng.integers(0, 3))):
            k = int(rng.integers(0, len(s) + 1))
            s = s[:k] + passages[int(rng.integers(0, 15))] + s[k:]
        if rng.random() < 0.1:
            s += "xy " * int(rng.integers(1, 300))
        if rng.random() < 0.1:
            s += "q" * int(rng.integers(1, 400))
        if rng.random() < 0.15 and out:
            s = out[int(rng.integers(0, len(out)))]
        out.append(s)
    return out + [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 250, "a" * 99]
