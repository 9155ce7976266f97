"""Operator 10, language ID: a bidirectional gated recurrent network over bytes.

The network reads a text as segments of ``SPAN`` bytes (all of them), labels
every byte position from the states of both directions, and pools the
position probabilities over the document. It is trained in numpy by
backpropagation through time on a bounded sample of labelled rows:
``FIT_DOCS`` distinct documents of each language (the smallest by a hash of id
and text) and up to ``FIT_SPANS`` segments of each, drawn over its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every text if there is no labelled row to learn from; a null lang is
never learned from; ties go to the smaller language name; repeated rows get
equal results; an empty table gives an empty result; further columns are
ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import slices

SPAN = 128
UNITS = 8
FIT_DOCS = 300
FIT_SPANS = 4
STEPS = 150
BATCH = 128
RATE = 0.03
SEED = 7
CHUNK = 2048
MIN_SCORE = 0.4

LETTER = regex.compile(r"\p{L}")


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes as rows of ``SPAN`` (zero-filled): rows, lengths, text of each."""
    size = np.array([len(t) for t in texts], np.int64)
    n = -(-size // SPAN)
    text = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    length = np.minimum(SPAN, size[text] - (np.arange(len(text)) - first[text]) * SPAN)
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % SPAN) for t in texts), np.uint8)
    return flat.reshape(-1, SPAN), length, text


class ByteGru:
    """Byte embeddings, weights of both directions and the label layer;
    states are columns: (units, segments)."""

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs, self.units = langs, units
        w = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float32)
        self.p = {"emb": w(units, 256), "c": np.zeros((len(langs), 1), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": w(3 * units, units), f"u{d}": w(3 * units, units), f"v{d}": w(len(langs), units)}

    def pooled(self, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(segments, languages): sums of the position probabilities."""
        out = np.zeros((len(rows), len(self.langs)))
        for whole in (True, False):
            at = np.flatnonzero((length == SPAN) == whole)
            for lo in range(0, len(at), CHUNK):
                part = at[lo:lo + CHUNK]
                out[part] = self._pooled(rows[part], None if whole else length[part])
        return out

    def _block(self, d: str) -> np.ndarray:
        """One matrix for a step on stacked (state, embedding): rows of the
        halved gate inputs, of the state's and of the byte's candidate part."""
        k, u, w = self.units, self.p["u" + d], self.p["w" + d]
        zero = np.zeros((k, k), np.float32)
        return np.block([[u[:2 * k] / 2, w[:2 * k] / 2], [u[2 * k:], zero], [zero, w[2 * k:]]]).astype(np.float32)

    def _run(self, d: str, emb: np.ndarray, order, live: np.ndarray | None):
        """Yield (position, state) in reading order; the state is reused."""
        k, block = self.units, self._block(d)
        stack = np.zeros((2 * k, emb.shape[2]), np.float32)
        h, g = stack[:k], np.empty((4 * k, emb.shape[2]), np.float32)
        zr, m, n = g[:2 * k], g[2 * k:3 * k], g[3 * k:]
        for t in order:
            stack[k:] = emb[t]
            np.dot(block, stack, out=g)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            m *= zr[k:]
            n += m
            np.tanh(n, out=n)
            h -= n
            h *= zr[:k]
            h += n
            if live is not None:
                h *= live[t]
            yield t, h

    def _pooled(self, rows: np.ndarray, length: np.ndarray | None) -> np.ndarray:
        cols = np.ascontiguousarray(rows.T).astype(np.intp)
        top, live = SPAN, None
        if length is not None:
            top = int(length.max())
            live = (np.arange(top)[:, None] < length[None, :]).astype(np.float32)
        emb = np.empty((top, self.units, len(rows)), np.float32)
        for j in range(self.units):
            emb[:, j] = self.p["emb"][j].take(cols[:top])
        ahead = np.empty((top, len(self.langs), len(rows)), np.float32)
        for t, h in self._run("f", emb, range(top), live):
            np.dot(self.p["vf"], h, out=ahead[t])
        total = np.zeros((len(self.langs), len(rows)), np.float32)
        for t, h in self._run("b", emb, reversed(range(top)), live):
            e = ahead[t]
            e += self.p["vb"] @ h
            e += self.p["c"]
            np.exp(e, out=e)
            e *= (1 if live is None else live[t]) / e.sum(axis=0)
            total += e
        return total.T

    def gradient(self, rows: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions and its gradient, by
        backpropagation through time in both directions."""
        p, k, n = self.p, self.units, len(rows)
        cols = np.ascontiguousarray(rows.T).astype(np.intp)
        mask = (np.arange(SPAN)[:, None] < length[None, :]).astype(np.float32)
        emb = np.stack([x.take(cols) for x in p["emb"]], 1)
        kept: dict = {}
        for d, order in (("f", range(SPAN)), ("b", range(SPAN - 1, -1, -1))):
            h = np.zeros((k, n), np.float32)
            for t in order:
                x, m = p["w" + d] @ emb[t], p["u" + d] @ h
                zr = 0.5 * np.tanh(0.5 * (x[:2 * k] + m[:2 * k])) + 0.5
                cand = np.tanh(x[2 * k:] + zr[k:] * m[2 * k:])
                new = (cand + zr[:k] * (h - cand)) * mask[t]
                kept[d, t] = (h, zr, cand, m[2 * k:], new)
                h = new
        g = {name: np.zeros_like(x) for name, x in p.items()}
        loss, scale, logit = 0.0, np.float32(1 / mask.sum()), {}
        for t in range(SPAN):
            e = p["vf"] @ kept["f", t][4] + p["vb"] @ kept["b", t][4] + p["c"]
            e = np.exp(e - e.max(axis=0))
            e /= e.sum(axis=0)
            loss -= float((np.log(e[label, np.arange(n)] + 1e-9) * mask[t]).sum()) * float(scale)
            e[label, np.arange(n)] -= 1
            e *= mask[t] * scale
            logit[t] = e
            g["c"] += e.sum(axis=1, keepdims=True)
            for d in "fb":
                g["v" + d] += e @ kept[d, t][4].T
        de = np.zeros_like(emb)
        for d, order in (("f", range(SPAN - 1, -1, -1)), ("b", range(SPAN))):
            back = np.zeros((k, n), np.float32)
            for t in order:
                old, zr, cand, m, _ = kept[d, t]
                z, r = zr[:k], zr[k:]
                dh = (back + p["v" + d].T @ logit[t]) * mask[t]
                dn = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (old - cand) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                dm, dx = np.concatenate([dz, dr, dn * r]), np.concatenate([dz, dr, dn])
                g["u" + d] += dm @ old.T
                g["w" + d] += dx @ emb[t].T
                de[t] += p["w" + d].T @ dx
                back = dh * z + p["u" + d].T @ dm
        for j in range(k):
            g["emb"][j] = np.bincount(cols.ravel(), weights=de[:, j].ravel(), minlength=256)
        return loss, g

    def fit(self, rows: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam on random batches; returns the losses."""
        rng, losses = np.random.default_rng(SEED), []
        first = {k: np.zeros_like(x) for k, x in self.p.items()}
        second = {k: np.zeros_like(x) for k, x in self.p.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, len(rows), min(BATCH, len(rows)))
            loss, g = self.gradient(rows[at], length[at], label[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * (1 if i < 0.7 * steps else 0.2)
            for k, x in g.items():
                x *= min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.01 * (x * x - second[k])
                self.p[k] -= (rate * (first[k] / (1 - 0.9 ** i)) /
                              (np.sqrt(second[k] / (1 - 0.99 ** i)) + 1e-7)).astype(np.float32)
        return losses


def _draw(batches):
    """Up to ``FIT_SPANS`` segments of each text, from anywhere in it."""
    for b in slices(batches, "text"):
        parts = []
        for key, t in zip(b.column("key").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()):
            n = -(-len(t) // SPAN)
            at = np.random.default_rng([SEED, key % (1 << 64)]).choice(n, min(n, FIT_SPANS), replace=False)
            parts.append([t[k * SPAN:(k + 1) * SPAN] for k in sorted(at.tolist())])
        yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), b.column("n"), pa.array(parts, pa.list_(pa.binary()))],
                                         names=["lang", "n", "parts"])


def train(labelled: DataFrame, fit_docs: int = FIT_DOCS, steps: int = STEPS) -> ByteGru | None:
    """Fit on a bounded sample of (text, lang) rows; None without any. The
    sample is at most ``fit_docs`` documents of a language; of each, segments
    drawn over its whole text are sent here."""
    keyed = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    order = Window.partitionBy("lang").orderBy("key")
    drawn = keyed.filter("lang is not null and text rlike '\\\\p{L}'").select("lang", "key").distinct() \
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fit_docs)
    rows = keyed.join(F.broadcast(drawn), ["lang", "key"]).select("lang", "n", "key", "text") \
        .mapInArrow(_draw, "lang string, n int, parts array<binary>").dropDuplicates(["lang", "n"]) \
        .orderBy("lang", "n").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    x, sizes, _ = spans([bytes(p) for r in rows for p in r["parts"]])
    labels = np.repeat([langs.index(r["lang"]) for r in rows], [len(r["parts"]) for r in rows])
    net = ByteGru(langs)
    net.fit(x, sizes, labels, steps)
    return net


def label_texts(net: ByteGru | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    known = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        raw = [texts[i].encode() for i in known]
        rows, length, text = spans(raw)
        sums = net.pooled(rows, length)
        prob = np.stack([np.bincount(text, weights=sums[:, j], minlength=len(raw)) for j in range(len(net.langs))], 1)
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        for i, row, j in zip(known, prob, best):
            lang[i], score[i] = net.langs[j], float(row[j])
    return lang, score


def predict(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    def run(batches):
        for b in slices(batches, "text"):
            lang, score = label_texts(net, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: ByteGru | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language is told with a
    score of ``min_score`` or more; ``und`` documents are rejected."""
    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        for lo in range(0, len(text), 512):
            lang, score = label_texts(net, [t if isinstance(t, str) else None for t in text.iloc[lo:lo + 512]])
            out[lo:lo + 512] = [k != "und" and s >= min_score for k, s in zip(lang, score)]
        return pd.Series(out)

    return docs.filter(known("text"))
