"""Operator 6, best-fit packing.

Documents become token ids (each followed by id 0); only documents longer
than a sequence are cut, into full pieces and a rest. Pieces are dealt at
random into groups of about ``GROUP`` full sequences of tokens (and of
``MOST_PIECES`` pieces at most); in each group best-fit decreasing runs with a
segment tree over the remaining capacities, which finds the tightest open
sequence in logarithmic time per piece. Groups are independent, so memory and
time per task are bounded; each costs at most part of one sequence against
packing all pieces at once: one in ``GROUP``, or for documents of 16 tokens and
less one in as many sequences as ``MOST_PIECES`` of them fill.

Tokens: the vocabulary file splits at white space, so each distinct word is
encoded once (about 2 * ``CACHE`` words are kept) and a document's ids are
those of its words in order, gathered in numpy.

Defined results: a null or empty text is the single id 0; repeated rows are
packed each; ties in length go by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices, staged, words_of

CAPACITY = 2048
GROUP = 2048
MOST_PIECES = 1 << 18
CACHE = 250_000
SLICE = 8 << 20

_loaded: dict = {}


def _parts(word: str) -> tuple[str, ...]:
    """What is encoded for a word: a plain Latin word is lower-cased, and a
    full stop or comma at its end set apart, as the vocabulary file does."""
    core = word[:-1] if word[-1] in ".," else word
    if core.isalpha() and (core.isascii() or max(core) < "\u017f" and "\u0130" not in core):
        return (core.lower(),) if core is word else (core.lower(), word[-1])
    return (word,)


class WordIds:
    """Ids of words as little-endian bytes. Words and their parts are kept
    until there are more than 2 * ``CACHE``; then only those of the last call."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # control strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        told = ["Word,", "ÉTÉ.", "plain"]
        # whether the file lower-cases and parts words as _parts does
        self.parted = self._encoded(told) == [b"".join(self._encoded(list(_parts(w)))) for w in told]

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def __call__(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        split = [_parts(words[i]) if self.parted else (words[i],) for i in missing]
        known = {p: self.known.get(p) for x in split for p in x}
        new = [p for p, v in known.items() if v is None]
        for lo in range(0, len(new), 20_000):
            part = new[lo:lo + 20_000]
            known.update(zip(part, self._encoded(part)))
        for i, x in zip(missing, split):
            out[i] = known[x[0]] if len(x) == 1 else known[x[0]] + known[x[1]]
        if len(self.known) > 2 * CACHE:
            self.known = dict(zip(words, out))
        self.known.update(known)
        self.known.update((words[i], out[i]) for i in missing)
        return out


def word_ids(path: str) -> WordIds:
    """One for each vocabulary file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def document_ids(texts: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each followed by id 0, and where each begins."""
    words, row = words_of(texts, lower=False)
    coded = words.dictionary_encode()
    ids = encode(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    code = np.asarray(coded.indices)
    n = size[code]
    at = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    total = np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64) + 1
    start = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(start[-1], "<u4")
    word = np.ones(start[-1], bool)
    word[start[1:] - 1] = False  # the zero after each document
    out[word] = flat[at]
    return out, start


def _pieces(path: str, capacity: int):
    def run(batches):
        encode = word_ids(path)
        for b in slices(batches, "text", SLICE):
            ids, begin = document_ids(b.column("text"), encode)
            size = np.diff(begin)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            at = np.append(begin[doc] + start, begin[-1])
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * at), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(np.diff(at)), out.cast(pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])
            del ids, out
            pa.default_memory_pool().release_unused()
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian)."""
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(path, capacity), "doc_id long, piece int, start long, length long, ids binary")


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree over capacities
    tells which of them have any."""

    def __init__(self, capacity: int):
        self.leaf = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaf)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = self.leaf + room
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the sequence with the least room >= need: (room, id)."""
        at = self.leaf + need
        while not self.any[at]:
            while at & 1:  # a right child: what lies beyond is under an ancestor's sibling
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaf:
            at *= 2
            at += not self.any[at]
        room = at - self.leaf
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return room, sequence


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; lengths must be descending."""
    bins, sequence, offset, n = OpenSequences(capacity), [], [], 0
    for size in lengths:
        found = bins.tightest(size)
        room, s = found if found else (capacity, n)
        n += found is None
        sequence.append(s)
        offset.append(capacity - room)
        if room > size:
            bins.put(room - size, s)
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``rows`` (any columns with ``length`` <= capacity) plus sequence_id and
    offset (the place in the sequence, gapless from 0); ``group`` is the number
    of full sequences whose tokens make a group."""
    kept = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n, tokens = kept.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n_groups = max(1, -(-tokens // (capacity * group)), -(-n // MOST_PIECES))
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n_groups)))

    def run(t: pa.Table) -> pa.Table:
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column("_row").to_numpy(), -length))
        sequence, offset = np.empty((2, len(order)), np.int64)
        sequence[order], offset[order] = best_fit(length[order].tolist(), capacity)
        sequence += t.column("_group")[0].as_py() << 32
        return t.drop_columns(["_row", "_group"]).append_column("sequence_id", pa.array(sequence)) \
            .append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole token sequences of pieces that carry ``ids``;
    a sequence has at most one capacity of tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")).alias("ids"))
