"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokens_index(docs, tokenizer, end_id=2):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def bpe(docs, tokenizer):
    out = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, len(ids), hashlib.sha256(data).hexdigest(), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def top_k(vectors, every=50, k=5):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q)))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def simhash(docs, bits=2):
    fps = {}
    for doc_id, text in docs:
        fps.setdefault(fingerprint(text), []).append(doc_id)
    values = list(fps)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits and root(a) != root(b):
                parent[root(a)] = root(b)
    least = {}
    for v in values:
        least[root(v)] = min([least.get(root(v), math.inf), *fps[v]])
    return [(d, f"{v:016x}", least[root(v)]) for v in values for d in fps[v]]


def secrets(docs):
    """The base columns only."""
    patterns = (("assign", re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
                ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), n, kind, m.end()) for n, (kind, pattern, group, least) in enumerate(patterns)
                 for m in pattern.finditer(text or "") if len(m[group]) >= least]
        of = Counter(s[2] for s in spans)
        out.append((doc_id, of["assign"], of["access"], of["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i:i + n]), set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    ids |= found
                    hit |= set(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(LOWER), m[2]


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)
