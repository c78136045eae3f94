"""Plain forms of the operators' rules, for small fixtures."""

from __future__ import annotations

import hashlib
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def given(name: str) -> list[dict]:
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def luhn(digits: str) -> bool:
    doubled = lambda d: 2 * d - 9 * (d > 4)
    return sum(doubled(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    count = lambda m: len(re.sub("[^0-9]", "", m))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= count(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= count(m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def shingles(text: str | None) -> frozenset:
    w = spaced(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows: list[tuple]) -> list[tuple]:
    """(id, shingles, component) of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = lambda g: [r[0] for r, h in zip(rows, group, strict=True) if g == h and r[0] is not None]
    return [(r[0], len(s), min(ids(g), default=None)) for r, s, g in zip(rows, sets, group, strict=True)]


def leaks(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    """Words, hit words, and ids of items."""
    w = alnum(text)
    hit, found = set(), set()
    for item, body in items:
        x = alnum(body)
        m = min(10, len(x))
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
        for p in range(len(w) - m + 1 if x else 0):
            if tuple(w[p : p + m]) in windows:
                hit.update(range(p, p + m))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)
