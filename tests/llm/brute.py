"""Plain restatements of the contracts, row by row, for small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    marked = {i + j for where in at.values() if len(where) > 1 for i in where for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked),
            len(words) < 10 or 100 * len(marked) > 20 * len(words))


def quality(rows, max_docs, min_share):
    """rows: (doc_id, text, source) -> list of (base..., kept, removed words)."""
    holders = defaultdict(set)
    for doc_id, text, source in rows:
        for line in set(norm_lines(text)):
            holders[source or "", line].add((doc_id, text))
    first = {}
    for key, docs in holders.items():
        if len(docs) > max_docs:
            first[key] = min((i for i, _ in docs if i is not None), default=None)
    out = []
    for doc_id, text, source in rows:
        b = base_rules(text)
        gone = sum(len(x.split(" ")) for x in norm_lines(text) if first.get((source or "", x), doc_id) != doc_id)
        out.append((*b, not b[-1] and b[0] - gone >= b[0] * min_share, gone))
    return out


def norm_lines(text):
    return [x for line in (text or "").split("\n") if (x := " ".join(WORD.findall(line.translate(AZ))))]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(AZ)


def line_dedup(texts, min_docs):
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if n[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(AZ))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, linked):
    """Smallest id reachable; linked: symmetric boolean matrix."""
    comp, order = {}, sorted(range(len(ids)), key=lambda i: ids[i])
    for i in order:
        if i in comp:
            continue
        todo = [i]
        comp[i] = ids[i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in comp:
                    comp[j] = ids[i]
                    todo.append(j)
    return [comp[i] for i in range(len(ids))]


def simhash_groups(ids, texts):
    fp = np.array([simhash(t) for t in texts], np.uint64)
    linked = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    return [(f"{int(f):016x}", c) for f, c in zip(fp, reach(ids, linked))]


def cosine_groups(ids, vectors, least=0.9):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    m = np.array([np.array(v, float) if o else np.zeros(1) for v, o in zip(vectors, ok)], object)
    n = len(ids)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(m[i]) == len(m[j]):
                c = m[i] @ m[j] / np.sqrt((m[i] @ m[i]) * (m[j] @ m[j]))
                linked[i, j] = linked[j, i] = c >= least
    return list(zip(linked.sum(1).tolist(), reach(ids, linked)))


def word_ids(text, tok):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def packed_pieces(ids, texts, tok, capacity=2048):
    out = []
    for i, t in zip(ids, texts):
        whole = word_ids(t, tok)
        for k, lo in enumerate(range(0, len(whole), capacity)):
            part = whole[lo:lo + capacity]
            out.append((i, k, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def unigram(rows, held):
    """rows: (doc_id, text) -> (held_out, n_tokens, n_known, N, base_score)."""
    docs = [WORD.findall((t or "").translate(AZ)) + [None] for _, t in rows]
    flags = [fold(i, 7) == held for i, _ in rows]
    c = Counter(w for d, h in zip(docs, flags) if not h for w in d)
    n, v = sum(c.values()), len(c)
    return [(h, len(d), sum(c[w] > 0 for w in d), n,
             float(sum(np.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in d))) for d, h in zip(docs, flags)]


def ppm(rows, held, order=5):
    """Scores of all rows by a plain recursion over context dictionaries
    (escape method D; shorter contexts count the contexts one byte longer)."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    coded = [bytes(order) + (t or "").encode() + b"\0" for _, t in rows]
    for (i, _), text in zip(rows, coded):
        if fold(i, 7) != held:
            for k in range(order, len(text)):
                for n in range(order, -1, -1):
                    counts = seen[n][text[k - n:k]]
                    counts[text[k]] += 1
                    if counts[text[k]] > 1:  # the shorter contexts know of this one
                        break

    def log(context, symbol):
        out, gone = 0.0, set()
        for n in range(order, -1, -1):
            counts = {s: c for s, c in seen[n].get(context[order - n:], {}).items() if s not in gone}
            total = sum(counts.values())
            if symbol in counts:
                return out + np.log10((counts[symbol] - 0.5) / total)
            if total:
                out += np.log10(0.5 * len(counts) / total)
            gone |= set(counts)
        return out - np.log10(256 - len(gone))

    return [sum(log(text[k - order:k], text[k]) for k in range(order, len(text))) for text in coded]


def source_sizes_and_targets(rows):
    """rows: (doc_id, text, source) -> {source: (size, target)}."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), set(order)
    while open_ and left > 1e-9:  # hand out by weight, take back what is above a limit, again
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    return {s: (size[s], target[s]) for s in order}


def audit(rows, labels):
    """rows: (doc_id, text, lang); labels: {doc_id: (good, toxic)} -> a row
    per part, order and step, by applying the filters one after another."""
    from itertools import permutations

    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(f, i, t):
        words = WORD.findall(t)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and i > first[t]}[f]

    docs = [(p or "", {f: fails(f, i, t or "") for f in "ABCDE"}, *labels.get(i, (0, 0))) for i, t, p in rows]
    out, removed_by = [], Counter()
    for order in permutations("ABCDE"):
        left = docs
        for step, f in enumerate(order, 1):
            gone = [d for d in left if d[1][f]]
            left = [d for d in left if not d[1][f]]
            for part in {d[0] for d in docs}:
                n = lambda ds: sum(d[0] == part for d in ds)
                removed_by[part, f] += n(gone)
                out.append([part, "".join(order), step, n(left), n(gone), n([d for d in docs if d[1][f]]) - n(gone),
                            n([d for d in docs if d[1][f] and sum(d[1].values()) == 1]),
                            sum(d[2] for d in gone if d[0] == part), sum(d[3] for d in gone if d[0] == part)])
    return [(*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out]


def fill_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"
