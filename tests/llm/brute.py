"""Plain versions of the operators, for small tables: rows are dicts with doc_id, text and more."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


KINDS = (
    ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    out = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(out)


def suffix_dedup(rows: list[dict], window: int = 200) -> dict:
    texts = [(r["text"] or "").encode() for r in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r["doc_id"], len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def passage_dedup(rows: list[dict], window: int = 13) -> list:
    first: dict[tuple, int] = {}
    big = 1 << 63
    rank = lambda r: big if r["doc_id"] is None else r["doc_id"]
    split = [words(r["text"]) for r in rows]
    for r, w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), rank(r))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(r):
                gone[i : i + window] = [True] * window
        out.append((r["doc_id"], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def simhash(text: str | None) -> int:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], ids: list, bits: int = 4) -> list:
    top = list(range(len(fps)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                top[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def edited(rows: list[dict]) -> list[tuple]:
    order = sorted(rows, key=lambda r: -r["doc_id"])
    out = []
    for i, r in enumerate(order):
        t, n = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        out.append((r["doc_id"], len(t), sha(e), t, e, n))
    return out


def shingles(text: str, k: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
