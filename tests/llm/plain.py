"""Brute-force versions of the operators, over Python lists."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def line_dedup(rows, min_chars=40, min_docs=5):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, text left)]"""
    docs, top = collections.Counter(), {}
    for doc, text in rows:
        for key in {line.strip(BLANKS).translate(LOWER) for line in (text or "").split("\n")}:
            if len(key) >= min_chars:
                docs[key] += 1
                top[key] = max(top.get(key, -1), -1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (docs.get(k := x.strip(BLANKS).translate(LOWER), 0) >= min_docs and top[k] != (-1 if doc is None else doc))]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def statistics(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def shingles(text):
    words = WORD.findall(text or "")
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows, threshold=0.8):
    """[(doc_id, text)] with distinct ids -> [(doc_id, class_id, n_links)]"""
    sets = [(doc, shingles(text)) for doc, text in rows]
    up = {doc: doc for doc, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return [(doc, root(doc), links[doc]) for doc, _ in sets]


def benchmark_windows(items):
    from actiontrail.llm.decontaminate import brute_words

    out = {}
    for item, text in items:
        words = brute_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            out.setdefault(tuple(words[i:i + 10]), set()).add("null" if item is None else str(item))
    return out


def hits(text, windows):
    """(words, hit word numbers, items)"""
    from actiontrail.llm.decontaminate import brute_words

    words, cover, items = brute_words(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            found = windows.get(tuple(words[i:i + size]))
            if found:
                cover.update(range(i, i + size))
                items |= found
    return words, cover, items
