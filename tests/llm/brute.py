"""Plain versions of the operators that SQL cannot express, for small inputs."""

import hashlib
from collections import Counter

import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_bytes(texts, window):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text (bytes)."""
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def without_repeated_runs(texts, window, words):
    """Each text (bytes) without the runs of that many words that consist of strings of ``window`` bytes seen elsewhere too."""
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        spans = [(a, b) for a, b in spans if len(t[a:b].split()) >= words]
        out.append(b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)])))
    return out


def repeated_words(texts, window):
    """n_words, n_removed, kept_sha256 of each text (bytes)."""
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def fingerprint(text, shingle=4):
    words = text.lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_components(ids, prints, budget=4):
    """Smallest id of each row's component."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(root(i)) for i in range(len(ids))]
