"""Plain versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def repeated_bytes(docs: list[tuple[int, str | None]], width: int = 200) -> dict[int, tuple[int, int, int, str]]:
    raw = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[p : p + width] for b in raw.values() for p in range(len(b) - width + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(docs: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for p in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][p : p + width]), i)
    out = {}
    for i, w in words.items():
        gone = bytearray(len(w))
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = b"\x01" * width
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(docs: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, tuple[int, int]]:
    """(class, links) of each document: the smallest id it is linked with, over steps; links count documents."""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    links = defaultdict(set)
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j != i)
        links[i] |= {j for j, n in common.items() if n / (len(s) + len(sets[j]) - n) >= least}
    label = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += links[j]
    return {i: (label[i], len(links[i])) for i in sets}
