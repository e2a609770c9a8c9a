"""Plain versions of the operators' results, on lists of (id, text)."""

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

from assayline.llm.byte_bpe import read_ranks

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODEC = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    special_tokens={},
)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def words(text):
    return (text or "").encode().translate(FOLD).split()


def token_counts(docs):
    out = []
    for i, t in docs:
        n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
        out.append((i, len(t.encode()), n, n > 1024))
    return order(out)


def coded(docs):
    out = []
    for i, t in docs:
        ids = CODEC.encode_ordinary(t)
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(CODEC.decode_bytes(ids))))
    return order(out)


def fingerprint(text, n=3):
    own = words(text)
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)] if len(own) >= n else [b" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, bits=2):
    marks = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        have = least.get(find(a))
        least[find(a)] = i if have is None else have if i is None else min(have, i)
    return order((i, f"{marks[a]:016x}", least[find(a)]) for a, (i, _) in enumerate(docs))


def removed(docs, length=50):
    """Masks of removed bytes, in the order of docs. A null id is larger than all others."""
    first = {}
    raw = [((1 << 63) - 1 if i is None else i, t.encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    masks = []
    for i, b in raw:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                mask[p : p + length] = b"\1" * length
        masks.append(mask)
    return masks


def cut(docs, length=50):
    out = []
    for (i, t), mask in zip(docs, removed(docs, length), strict=True):
        runs = sum(1 for p, x in enumerate(mask) if x and (p == 0 or not mask[p - 1]))
        kept = bytes(x for x, gone in zip(t.encode(), mask, strict=True) if not gone)
        out.append((i, len(mask), sum(mask), runs, sha(kept)))
    return order(out)


def whole_characters(text, mask):
    """What is left of a text if a character goes only with all its bytes."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not all(mask[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of sources by resharing what is above the caps until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, got, left = set(names), {}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return got | {s: level * weight[s] for s in open_}
        for s in over:
            got[s] = float(most * sizes[s])
            left -= got[s]
        open_ -= over
    return got


def language_model(docs, held, discount=0.75, least=1):
    """Scores of docs; held: whether an id is not learned from."""
    tokens = [[*words(t), b" "] for _, t in docs]
    count, pairs = Counter(), Counter()
    for (i, _), own in zip(docs, tokens, strict=True):
        if not held(i):
            count.update(own)
            pairs.update(zip([b" ", *own[:-1]], own, strict=True))
    total, distinct = sum(count.values()), len(count)
    kept = {p: n for p, n in pairs.items() if n >= least and count[p[0]] >= least and count[p[1]] >= least}
    mass = Counter()
    for (v, _), n in kept.items():
        mass[v] += (n - discount) / count[v]
    out = []
    for (i, _), own in zip(docs, tokens, strict=True):
        base = [(count[w] + 1) / (total + distinct + 1) for w in own]
        chance = [
            ((kept[v, w] - discount) / count[v] if (v, w) in kept else 0) + (1 - mass[v]) * p
            for v, w, p in zip([b" ", *own[:-1]], own, base, strict=True)
        ]
        known = sum(count[w] > 0 for w in own)
        out.append((i, len(own), known, total, sum(map(math.log10, base)), sum(map(math.log10, chance))))
    return out


def in_fold(ident, folds, fold):
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % folds == fold
