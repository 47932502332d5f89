"""Plain forms of what the operators compute, in Python over small inputs."""

import hashlib
import random

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return (text or "").encode().split()


def quality(text):
    words = words_of(text)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    seen, repeated = {}, set()
    for at in range(len(words) - 7):
        seen.setdefault(tuple(words[at : at + 8]), []).append(at)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(at + step for at in places for step in range(8))
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(repeated)


def cut(docs, width=20):
    """``{doc_id: (words, removed, digest)}`` of ``(doc_id, text)`` rows."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda row: row[0]):
        words = words_of(text)
        covered = [False] * len(words)
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if window in seen:
                covered[at : at + width] = [True] * width
            seen.add(window)
        kept = [word for word, gone in zip(words, covered, strict=True) if not gone]
        out[key] = (len(words), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return set()
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))}


def similar(one, two):
    common = len(one & two)
    return bool(one and two) and 100 * common >= 75 * (len(one) + len(two) - common)


def groups(docs):
    """``{doc_id: (shingles, component)}``; keys are unique."""
    sets = {key: shingles(text) for key, text in docs}
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for number, one in enumerate(keys):
        for two in keys[number + 1 :]:
            if find(one) != find(two) and similar(sets[one], sets[two]):
                a, b = sorted((find(one), find(two)))
                root[b] = a
    return {key: (len(sets[key]), find(key)) for key in keys}


def greedy_pieces(word, pieces, end=256):
    """Longest-match pieces of a word with its end mark; None if it has none."""
    symbols, at, count = (*word, end), 0, 0
    while at < len(symbols):
        size = next((n for n in range(len(symbols) - at, 0, -1) if symbols[at : at + n] in pieces), 0)
        if not size:
            return None
        count += symbols[at : at + size] != (end,)
        at += size
    return count


def copies(seed, count=60, vocabulary=400, length=90):
    """Texts of which many are edited copies of others, with shared passages, and odd ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(30)]
    texts = [None, "", "  \n\t ", "one", "Two Words", "a " * 60, "x" * 5000, "é ü\x0bñ\x0c ß"]
    for _ in range(count):
        kind = rng.random()
        base = rng.choice([t for t in texts if t] or ["a"]).split() if kind < 0.5 else [word() for _ in range(rng.randrange(length))]
        base = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if base:
                base[rng.randrange(len(base))] = word()
        if kind > 0.8:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        texts.append(rng.choice([" ", "\n"]).join(base))
    return texts
