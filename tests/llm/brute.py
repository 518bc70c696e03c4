"""Plain Python statements of what the operators return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def pii(text: str | None) -> list[str]:
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans, found by walking the text: by start, then by kind as listed."""
    t, out = text or "", []

    def run(at: int, alphabet: str) -> int:
        while at < len(t) and t[at] in alphabet:
            at += 1
        return at

    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = upper + upper.lower() + digits + "+/_.=-"

    def assign(at: int) -> tuple[int, int] | None:
        """End and length of the value of an assignment that starts here."""
        low = t[at:at + 8].translate(ASCII)
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n)), None)
        if name is None:
            return None
        k = at + len(name)
        k = run(k + (t[k:k + 1] in ("'", '"')), " ")
        if t[k:k + 1] not in (":", "="):
            return None
        k = run(k + 1, " ")
        k += t[k:k + 1] in ("'", '"')
        end = run(k, value)
        return (end, end - k) if end > k else None

    def access(at: int) -> tuple[int, int] | None:
        end = run(at + 4, upper + digits) if t.startswith("AKIA", at) else 0
        return (end, end - at) if end > at + 4 else None

    def hexed(at: int) -> tuple[int, int] | None:
        end = run(at, digits + "abcdef")
        return (end, end - at) if end > at else None

    for order, (kind, match, least) in enumerate((("assign", assign, 12), ("access", access, 18), ("hex", hexed, 16))):
        at = 0
        while at < len(t):
            found = match(at)
            if found and found[1] >= least:
                out.append((at, order, kind, found[0]))
            at = found[0] if found else at + 1
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def lines(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(n_lines, n_dropped, kept) per row."""
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)

    holders: dict[str, set] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= 5}
    out = []
    for i, t in docs:
        rows = (t or "").split("\n")
        kept = [r for r in rows if key(r) not in gone or gone[key(r)] == i]
        out.append((len(rows), len(rows) - len(kept), "\n".join(kept)))
    return out


def repeats(texts: list[str | None], length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    w = words((text or "").translate(ASCII))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple[int, str | None]], distance: int = 3) -> dict[int, int]:
    prints = {i: fingerprint(t) for i, t in docs}
    parent = {i: i for i in prints}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def quality(text: str | None) -> tuple:
    w = words(text)
    n, seen, dup = len(w), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(w[k:k + 3]) for k in range(n - 2))
    covered = {k + j for k in range(n - 2) if triples[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.8) -> dict[tuple[int, int], float]:
    """Best weighted Jaccard similarity of five-word shingles over all item-sized windows, where it reaches ``least``."""
    def shingles(w: list[str]) -> Counter:
        return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))

    out = {}
    for item, text in items:
        own = words((text or "").translate(ASCII))
        for doc, body in docs:
            w = words((body or "").translate(ASCII))
            for s in range(max(1, len(w) - 4) if own else 0):
                a, b = shingles(w[s:s + len(own)]), shingles(own)
                like = (a & b).total() / (a | b).total()
                if like >= least and w:
                    out[doc, item] = max(like, out.get((doc, item), 0.0))
    return out
