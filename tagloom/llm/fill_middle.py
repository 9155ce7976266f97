"""Operator 13, fill-in-middle transformation with a learned rank index.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). Where the units of a run
of texts end is one ascending sequence of offsets; a rank index is learned over
all of it: straight segments from rank to offset, each as long as it stays
within ``ERROR`` of all its offsets, and the residual of every offset as a
16-bit number. A cut after k units is predicted by the segment of its rank and
corrected by the stored residual, which is exact.

Two cuts drawn from a hash of the doc_id part a text into prefix, middle and
suffix, which are put out in the order prefix-suffix-middle or
suffix-prefix-middle between sentinels. A text that is empty, holds a sentinel
or is not drawn (``RATE`` percent are) stays plain.

One pass over the texts, without a shuffle; memory is bounded by a run of
texts (8 MB, or one longer text).

Defined results: a null text is empty; a null doc_id hashes as empty text;
repeated rows get equal results; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 100
SPM_RATE = 50
SEED = 7
ERROR = 1023
WINDOW = 64


class RankIndex:
    """Rank -> offset for an ascending sequence: error-bounded segments and
    residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        offsets = np.asarray(offsets, np.int64)
        first, slope, at = [], [], 0
        while at < len(offsets):
            lo, hi, end, width = -np.inf, np.inf, at + 1, WINDOW
            while end < len(offsets):  # narrow the cone of slopes until no line is left
                run = np.arange(1, min(width, len(offsets) - end) + 1) + (end - at - 1)
                rise = offsets[at + run] - offsets[at]
                low = np.maximum.accumulate(np.maximum((rise - error) / run, lo))
                high = np.minimum.accumulate(np.minimum((rise + error) / run, hi))
                good = int(np.argmin(low <= high)) if (low > high).any() else len(run)
                if good:
                    lo, hi, end = low[good - 1], high[good - 1], end + good
                if good < len(run):
                    break
                width *= 2
            first.append(at)
            slope.append((lo + hi) / 2 if end > at + 1 else 0.0)
            at = end
        self.first = np.array(first, np.int64)
        self.slope = np.array(slope)
        self.base = offsets[self.first] if len(offsets) else offsets
        residual = offsets - self.predict(np.arange(len(offsets)))
        self.residual = residual.astype(np.int16 if error < 1 << 15 else np.int64)

    def predict(self, rank: np.ndarray) -> np.ndarray:
        if not len(rank):
            return np.zeros(0, np.int64)
        s = np.searchsorted(self.first, rank, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of ranks."""
        return self.predict(rank) + self.residual[rank]


def boundaries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in the concatenated texts at which a text begins or a unit
    ends, ascending, and the rank of each text's beginning (one more at the
    end). A text of n units has n + 1 of them."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    open_end = np.array([len(t) > 0 and t[-1] != 10 for t in texts], bool)
    cut = np.flatnonzero(flat == 10) + 1
    text = np.searchsorted(ends, cut - 1, "right")
    n = np.bincount(text, minlength=len(texts)) + open_end
    start = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(start[-1], np.int64)
    out[start[:-1]] = ends - size
    nth = np.arange(len(cut)) - np.searchsorted(text, text)
    out[start[text] + 1 + nth] = cut
    out[start[1:][open_end] - 1] = ends[open_end]
    return out, start


def _chars(b: bytes) -> int:
    return len(b) - int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) == 0x80))


def _transform(rate: int, spm_rate: int, error: int):
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for b in slices(batches, "text"):
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            offsets, start = boundaries(texts)
            index = RankIndex(offsets, error)
            n = np.diff(start) - 1
            h1, h2, h3, h4 = (np.asarray(b.column(f"h{i}")) for i in (1, 2, 3, 4))
            one, two = h1 % (n + 1), h2 % (n + 1)
            begin = offsets[start[:-1]]
            first = index.offset(start[:-1] + np.minimum(one, two)) - begin
            second = index.offset(start[:-1] + np.maximum(one, two)) - begin
            plain = (h3 % 100 >= rate) | np.array([not t or any(m in t for m in marks) for t in texts], bool)
            form, out, prefix_chars, middle_chars = [], [], [], []
            for t, p, x, y, spm in zip(texts, plain, first.tolist(), second.tolist(), h4 % 100 < spm_rate):
                prefix, middle, suffix = t[:x], t[x:y], t[y:]
                form.append("plain" if p else "spm" if spm else "psm")
                prefix_chars.append(None if p else _chars(prefix))
                middle_chars.append(None if p else _chars(middle))
                out.append(t if p else b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle] if spm else
                                                [marks[0], prefix, marks[1], suffix, marks[2], middle]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(form), pa.array(prefix_chars, pa.int64()),
                 pa.array(middle_chars, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def draws(doc_id: str, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of 8 hexadecimal digits of the sha256
    of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, error: int = ERROR) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars,
    middle_chars (null if plain), output."""
    return docs.select("doc_id", "text", *draws("doc_id", seed)).mapInArrow(
        _transform(rate, spm_rate, error),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: str, form: str) -> Column:
    """The text behind an output. No sentinel can arise where a piece and a
    sentinel meet, as each begins with its only '<' and ends with its only '>'."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])) \
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
