"""Operator 3, byte-level BPE encoding and decoding with DuckDB per partition.

A task splits its texts by the vocabulary's pattern and sends the pieces that
are not tokens themselves to an in-process DuckDB: rows (word, position,
token) join the merge table, and a recursive query contracts each word's
leftmost pair of minimum rank until none is left.

Between white space and the next the pattern is free of context, so a text is
first cut before white space; each distinct cut of a batch is encoded once
(with a cache of 2 * ``CACHE`` pieces) and a text's ids are those of its cuts. A word's
recursion runs ``ROUNDS`` contractions per query and goes on from there until
its fixpoint, so a very long word needs time but not memory. Decoding joins a
batch's distinct ids with the vocabulary; its texts are put together from those.

Defined results: a null or empty text has no ids and decodes to no bytes;
control strings are ordinary text; repeated rows get equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tagloom.llm.common import Recent, slices

CACHE = 300_000
WORDS = 30_000
ROUNDS = 48

#: fixed value: the white space of the pattern's \s (Unicode White_Space)
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A row carries its right neighbour (np: position, nt: token). The best pair of
#: a word is the one of least rank, then of least position; its left row takes
#: the merged token, its right row goes. A word without a pair leaves the recursion.
_MERGE = f"""
WITH RECURSIVE step AS (
    SELECT word, pos, tok, lead(pos) OVER w AS np, lead(tok) OVER w AS nt, 0 AS round
    FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT c.word, c.pos, CASE WHEN c.pos = b.pos THEN b.merged ELSE c.tok END,
           CASE WHEN c.pos = b.pos THEN b.after_pos ELSE c.np END,
           CASE WHEN c.pos = b.pos THEN b.after_tok WHEN c.np = b.pos THEN b.merged ELSE c.nt END, c.round + 1
    FROM step c JOIN (
        SELECT x.word, x.pos, x.gone, x.merged, y.np AS after_pos, y.nt AS after_tok
        FROM (SELECT word, arg_min(pos, key) AS pos, arg_min(np, key) AS gone, min(key) >> 40 AS merged
              FROM (SELECT word, pos, np, merged::BIGINT << 40 | pos AS key
                    FROM step JOIN merges ON tok = l AND nt = r) GROUP BY word) x
        JOIN step y ON y.word = x.word AND y.pos = x.gone) b USING (word)
    WHERE c.pos <> b.gone AND c.round < {ROUNDS})
SELECT word, pos, tok, round
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """A rank file as tables of an in-process DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.rank = read_ranks(path)
        self.pieces = regex.compile(
            pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.cuts = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.recent_pieces = Recent(CACHE)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1})
        rows = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()),
                         "merged": pa.array(merged, pa.int32())})
        self.db.register("merge_rows", rows)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian bytes) of words that are not tokens themselves."""
        out: list[bytes] = [b""] * len(words)
        for lo in range(0, len(words), WORDS):
            part = words[lo:lo + WORDS]
            size = np.array([len(w) for w in part])
            word = np.repeat(np.arange(lo, lo + len(part)), size)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            tok = self.byte[np.frombuffer(b"".join(part), np.uint8)]
            while len(word):
                start = pa.table({"word": word, "pos": pos, "tok": tok})
                self.db.register("start", start)
                got = self.db.execute(_MERGE).fetchnumpy()
                order = np.lexsort((got["pos"], got["word"]))
                word, pos, tok, n = (np.asarray(got[c])[order] for c in ("word", "pos", "tok", "round"))
                done = n < ROUNDS
                ends, toks = word[done], tok[done].astype("<u4")
                first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else []
                for i, j in zip(first, np.r_[first[1:], len(ends)] if len(ends) else []):
                    out[ends[i]] = toks[i:j].tobytes()
                word, pos, tok = word[~done], pos[~done], tok[~done]
        return out

    def piece_ids(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        known = {p: i.to_bytes(4, "little") for p in pieces if (i := self.rank.get(p)) is not None}
        known |= {p: v for p in pieces - known.keys() if (v := self.recent_pieces.get(p)) is not None}
        new = list(pieces - known.keys())
        for p, v in zip(new, self.merge(new)):
            known[p] = v
            self.recent_pieces.put(p, v)
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.cuts(t) for t in texts]
        cuts = list(set().union(*split))
        parts = [[p.encode() for p in self.pieces(c)] for c in cuts]
        ids = self.piece_ids({p for x in parts for p in x})
        known = {c: b"".join([ids[p] for p in x]) for c, x in zip(cuts, parts)}
        return [b"".join([known[c] for c in cuts]) for cuts in split]


class Decoder:
    """The vocabulary of a rank file as a table of an in-process DuckDB; a
    token's bytes are kept as code points 0 to 255."""

    def __init__(self, path: str):
        import duckdb

        rank = read_ranks(path)
        names = pa.table({"tok": pa.array(list(rank.values()), pa.int32()),
                          "bytes": pa.array([t.decode("latin-1") for t in rank], pa.string())})
        self.db = duckdb.connect(":memory:", config={"threads": 1})
        self.db.register("token_rows", names)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM token_rows")
        self.db.unregister("token_rows")

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        tokens = np.flatnonzero(np.bincount(flat))
        self.db.register("coded", pa.table({"tok": tokens}))
        got = self.db.execute("SELECT tok, bytes FROM coded JOIN vocabulary USING (tok)").fetchnumpy()
        names = np.full(len(tokens) and tokens[-1] + 1, b"", object)
        names[got["tok"].astype(np.int64)] = [t.encode("latin-1") for t in got["bytes"]]
        pieces, ends = names[flat].tolist(), np.cumsum(size).tolist()
        return [b"".join(pieces[lo:hi]) for lo, hi in zip([0, *ends], ends)]


_loaded: dict[tuple, object] = {}


def load(kind, *args):
    """One of a kind per Python worker."""
    if (kind, args) not in _loaded:
        _loaded[kind, args] = kind(*args)
    return _loaded[kind, args]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit)."""
    def run(batches):
        bpe = load(Bpe, path, pattern)
        for b in slices(batches, "text", 4 << 20):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The rows of (doc_id, ids) and their bytes, ``decoded``."""
    def run(batches):
        decoder = load(Decoder, path)
        for b in slices(batches, "ids", 4 << 20):
            out = decoder.decode([x or b"" for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, ids, decoded."""
    def run(batches):
        bpe, decoder = load(Bpe, path, pattern), load(Decoder, path)
        for b in slices(batches, "text", 4 << 20):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(decoder.decode(ids), pa.binary())],
                names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")
