"""Plain Python versions that the operators are compared with, and small tables."""

import itertools
import re
import struct

#: (doc_id, text) with nulls, blanks, copies, near copies, repeated rows and ids, odd spacing and long texts.
LONG = " ".join(f"word{i % 997} and{i % 31}," for i in range(6000))
ODD_TEXTS = [
    None, "", " ", "a", "a  b", " a b ", "a\n b", "x\t\ty  \n", "Été à l'Ñandú", "é e ́x", "<|endoftext|> b",
    "it's  we'll  go", " wide   x", "a\x1cb \x1c c", "ΣΑΣ ς", "12 345  6,7", "😀 😀x 😀", "é" * 300, LONG]


def documents(spark, texts=None, first=0):
    rows = [(i + first, t) for i, t in enumerate(ODD_TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_hashes(text, shingle=3):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [words[i:i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
    return [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]


def fingerprint(text, shingle=3):
    hashes = shingle_hashes(text, shingle)
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    """Smallest key reachable over links, by union-find over all pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(root), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def as_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)
