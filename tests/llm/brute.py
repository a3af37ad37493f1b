"""Plain versions of the contracts, one text at a time: what the Spark queries are held against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log10

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def crc(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base span."""
    out = []
    for nr, kind in enumerate(KINDS):
        for m in PATTERNS[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), nr, m.end()))
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[n]}:{s}:{e}" for s, n, e in spans)


def rules(text: str | None) -> dict:
    words = SPACED.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": n < 10 or 100 * len(inside) > 20 * n}


def decontaminated(docs: list[tuple], items: list[tuple]) -> dict:
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if w:
            n = min(13, len(w))
            windows.setdefault(item, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    by: dict[tuple, set] = {}
    for item, own in windows.items():
        for x in own:
            by.setdefault(x, set()).add(str(item))
    sizes = {len(x) for x in by}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in by:
                    hit.update(range(i, i + n))
                    found |= by[tuple(w[i : i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def base_scores(docs: list[tuple]) -> dict:
    words = {d: [*SPACED.findall((t or "").translate(LOWER)), None] for d, t in docs}
    counts = Counter(w for d, own in words.items() if crc(d, 10) != 0 for w in own)
    total, distinct = sum(counts.values()), len(counts)
    return {d: (len(own), sum(counts[w] > 0 for w in own), total, sum(log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)) for d, own in words.items()}


def components(docs: list[tuple]) -> dict:
    sets = {}
    for d, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    for a, b in {(x, y) for own in by.values() for x in own for y in own if x < y}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def lm_scores(docs: list[tuple], most: float = 0.5, part: float = 100.0) -> dict:
    """log10 probability by exact counts: a pair's share of its first word, interpolated with the word's own."""
    words = {d: [*SPACED.findall((t or "").translate(LOWER)), None] for d, t in docs}
    seen = {d: own for d, own in words.items() if crc(d, 10) != 0}
    single = Counter(w for own in seen.values() for w in own)
    pairs = Counter(p for own in seen.values() for p in zip(["<s>", *own], own))
    total, distinct, starts = sum(single.values()), len(single), len(seen)
    out = {}
    for d, own in words.items():
        score = 0.0
        for v, w in zip(["<s>", *own], own):
            context = starts if v == "<s>" else single[v]
            share = min(most, context / (context + part))
            joint = min(1.0, pairs[v, w] / max(context, 1))
            score += log10(share * joint + (1 - share) * (single[w] + 0.1) / (total + 0.1 * (distinct + 1)))
        out[d] = (len(own), score)
    return out


def log_ratio_scores(docs: list[tuple], trusted: set, buckets: int) -> dict:
    """Mean over words and word pairs of log(p_trusted / p_all), features hashed as 64-bit XXH64 with seed 42 into buckets."""
    import struct
    from math import log

    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    word = lambda w: signed(xxhash.xxh64(w.encode(), seed=42).intdigest())
    pair = lambda a, b: signed(xxhash.xxh64(struct.pack("<q", b), seed=xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()).intdigest())
    features = {}
    for d, t in docs:
        hashes = [word(w) for w in SPACED.findall(t or "")]
        features[d] = [h % buckets for h in hashes] + [pair(a, b) % buckets for a, b in zip(hashes, hashes[1:])]
    own, every = Counter(f for d in trusted for f in features[d]), Counter(f for x in features.values() for f in x)
    n_own, n = sum(own.values()), sum(every.values())
    ratio = lambda f: log((own[f] + 1) / (n_own + buckets)) - log((every[f] + 1) / (n + buckets))
    return {d: sum(map(ratio, x)) / len(x) if x else 0.0 for d, x in features.items()}


def languages(docs: list[tuple], n: int, least_docs: int, least_part: float) -> dict:
    """By exact sets of letter runs: the language that holds the largest part of a text's runs, and that part."""
    letters = re.compile(r"[\W\d_]+")

    def runs(text: str | None) -> set | None:
        plain = letters.sub(" ", (text or "").lower()).strip()
        return {(f" {plain} ")[i : i + n] for i in range(len(plain) + 3 - n)} if plain else None

    learned = [(lang, runs(t)) for d, t, lang in docs if lang is not None and crc(d, 4) != 2]
    counts: dict = {}
    sizes = Counter(lang for lang, _ in learned)
    for lang, own in learned:
        counts.setdefault(lang, Counter()).update(own or ())
    share = {lang: {r: k / sizes[lang] for r, k in c.items()} for lang, c in counts.items()}
    best: Counter = Counter()
    for own in share.values():
        for r, x in own.items():
            best[r] = max(best[r], x)
    kept = {lang: {r for r, x in own.items() if counts[lang][r] >= least_docs and x >= least_part * best[r]} for lang, own in share.items()}
    out = {}
    for d, t, _ in docs:
        own = runs(t)
        if own is None or not kept:
            out[d] = ("und", 0.0)
        else:
            found = {lang: len(own & kept[lang]) for lang in sorted(kept)}
            top = max(sorted(found), key=lambda x: found[x])
            out[d] = (top, found[top] / len(own) if own else 0.0)
    return out
