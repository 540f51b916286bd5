"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import xxhash

WHITE = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE[1:]:
        lower = lower.replace(c, " ")
    return [word for word in lower.split(" ") if word]


def shingles(text: str | None, size: int) -> list[str]:
    found = words(text)
    if len(found) < size:
        return [" ".join(found)] if found else []
    return [" ".join(found[at : at + size]) for at in range(len(found) - size + 1)]


def parts(nodes, links) -> dict:
    """Each node's smallest reachable node."""
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def fingerprint(text: str | None) -> int:
    hashes = [xxhash.xxh64_intdigest(each.encode(), 42) for each in shingles(text, 3)]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def near_copies(texts: dict[int, str]) -> dict[int, tuple[str, int]]:
    prints = {doc: fingerprint(text) for doc, text in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    component = parts(prints, links)
    return {doc: (f"{bits:016x}", component[doc]) for doc, bits in prints.items()}


def leaks(docs: dict, items: dict) -> dict:
    found = {}
    for doc, text in docs.items():
        for item, wanted in items.items():
            need = set(shingles(wanted, 5))
            size = min(5, len(words(wanted)))
            own = set(shingles(text, size)) if len(words(text)) >= size else set()
            if need and 10 * len(need & own) >= 8 * len(need):
                found[doc, item] = len(need & own)
    return found


def key_of(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def kept_lines(texts: dict[int, str | None], min_docs: int = 3) -> dict[int, tuple[int, str]]:
    holders = defaultdict(set)
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc)
    found = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        left = []
        for line in lines:
            key = key_of(line)
            often = len(key) >= 20 and len(holders[key]) >= min_docs
            if not often or doc == max(holders[key]):
                left.append(line)
        found[doc] = (len(lines) - len(left), "\n".join(left))
    return found


class KneserNey:
    """The same model with dictionaries."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        self.levels = {}
        top = Counter()
        raw = Counter()
        for text in texts:
            tokens = ["<s>"] * (order - 1) + words(text) + ["</s>"]
            top.update(tuple(tokens[at : at + order]) for at in range(len(tokens) - order + 1))
            raw.update(tokens[order - 1 :])
        self.raw = raw
        counts = top
        for level in range(order, 0, -1):
            self.levels[level] = counts
            lower = Counter()
            for gram in counts:
                lower[gram[1:]] += 1
            counts = lower

    def discount(self, level: int, count: int) -> float:
        t = Counter(self.levels[level].values())
        t1, t2, t3, t4 = (t[k] for k in (1, 2, 3, 4))
        y = t1 / (t1 + 2 * t2) if t1 and t2 else 0.5
        found = [
            1 - 2 * y * t2 / t1 if t1 and t2 else 0.5,
            2 - 3 * y * t3 / t2 if t2 and t3 else 1.0,
            3 - 4 * y * t4 / t3 if t3 and t4 else 1.5,
        ]
        return min(max(found[min(count, 3) - 1], 0.0), min(count, 3)) if count else 0.0

    def chance(self, gram: tuple) -> float:
        level = len(gram)
        if not level:
            return 1 / (len(self.raw) + 1)
        counts = self.levels[level]
        followers = [c for other, c in counts.items() if other[:-1] == gram[:-1]]
        if not followers:
            return self.chance(gram[1:])
        own = counts.get(gram, 0)
        rest = sum(self.discount(level, c) for c in followers)
        return (own - self.discount(level, own) + rest * self.chance(gram[1:])) / sum(followers)

    def score(self, text: str | None) -> float:
        tokens = ["<s>"] * (self.order - 1) + words(text) + ["</s>"]
        return sum(math.log10(self.chance(tuple(tokens[at : at + self.order]))) for at in range(len(words(text)) + 1))
