"""Plain-Python statements of what the set-similarity operators must return."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    found = words(text)
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))) if found else frozenset()


def similar(x, y):
    common = len(x & y)
    return bool(x) and bool(y) and 100 * common >= 75 * (len(x) + len(y) - common)


def similar_pairs(sets):
    """Pairs of positions of similar sets, by a look-up of every shingle."""
    index, out = {}, []
    for i, x in enumerate(sets):
        near = set()
        for token in x:
            near.update(index.get(token, ()))
            index.setdefault(token, []).append(i)
        out += [(j, i) for j in sorted(near) if similar(x, sets[j])]
    return out


def components(sets):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in similar_pairs(sets):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def kept_text(rows):
    """(doc_id, text) with later lines cut out, in order of doc_id; texts must be whole."""
    lines = [(d, n, shingles(line)) for d, text in rows for n, line in enumerate((text or "").split("\n")) if words(line)]
    gone = {lines[b][:2] for _, b in similar_pairs([x for _, _, x in lines])}
    return {d: "\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in gone) for d, text in rows}
