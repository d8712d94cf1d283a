"""Plain versions of the operators, written from their definitions and not from their code."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, words: int) -> set:
    found = WORD.findall(lower_az(text or ""))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def near_duplicate_rows(docs: list[tuple], words: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) with unique ids."""
    sets = {d: shingle_set(t, words) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                common[min(a, b), max(a, b)] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(sets[d]), find(d), find(d) == d) for d, _ in docs]


def exact_rows(docs: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text) with unique ids."""
    groups = defaultdict(list)
    for d, t in docs:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), d))
    return [
        (d, min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(bare.encode()).hexdigest())
        for bare, g in groups.items() for _, d in g
    ]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n *= 2
            if n > 9:
                n -= 9
        total += n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple]:
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    }
    return [
        (kind, m.start(), m.end())
        for kind, (pattern, good) in rules.items() for m in re.finditer(pattern, text) if good(m[0])
    ]


def ids_crc(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
