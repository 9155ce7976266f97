"""M5 "distributions": topic shares of documents from sliding token windows.

A window is ``window`` tokens (a shorter document is one window); its vector
are its words' counts times the class model's idf, its score for a topic the
cosine with the topic's c-TF-IDF vector, 0 below ``min_similarity``. A topic's
share of a document is its part of the sum of all scores.

Documents go into blocks of about ``BLOCK_TOKENS`` tokens; a block gets the
model rows of its own words only (a join on the word). Windows stay numpy rows
inside a block, some topics at a time: they are folded back to documents (or to
tokens) there and never become table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, tokens

BLOCK_TOKENS = 1 << 17
TOKEN_BYTES = 6  # of text a token, about; block sizes need no exact count
TOPICS_AT_ONCE = 16
RUN = 1 << 14  # places scored at once


class Windows:
    """The windows of a block: places of their tokens, and their norms. Sums
    over a window are sums of shifted slices of the block's tokens."""

    def __init__(self, docs: pa.ListArray, terms: pa.Array, idf: np.ndarray, window: int, stride: int):
        self.size = size = np.diff(np.asarray(docs.offsets)).astype(np.int64)
        room = np.where(size > 0, np.maximum(size, window), 0)  # short documents are filled up with no words
        start = np.concatenate([[0], np.cumsum(room)])
        found = pc.fill_null(pc.index_in(docs.flatten(), value_set=terms), len(idf))
        self.ids = np.full(start[-1], len(idf), np.int64)
        self.ids[np.arange(size.sum()) + np.repeat(start[:-1] - (np.cumsum(size) - size), size)] = found
        n = np.where(room > 0, (room - window) // stride + 1, 0)
        self.doc = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.first = start[self.doc] + nth * stride
        self.begin, self.window = start, window
        places = max(len(self.ids) - window + 1, 0)
        square = np.append(idf * idf, 0.0)[self.ids]
        norm = sum(square[j:places + j] for j in range(window))
        for i in range(window):  # a repeated word counts (n * idf)^2
            for j in range(i + 1, window):
                same = self.ids[i:places + i] == self.ids[j:places + j]
                norm = norm + 2 * np.where(same, square[i:places + i], 0.0)
        self.norm = np.sqrt(norm)

    def scores(self, model: np.ndarray, least: float):
        """(windows, their scores by topic) of ``RUN`` places at a time, as a
        slice and rows; a model (words, topics) of idf * weight / topic norm."""
        model = np.vstack([model, np.zeros(model.shape[1])])
        for a in range(0, len(self.norm), RUN):
            places = min(RUN, len(self.norm) - a)
            some = slice(*np.searchsorted(self.first, [a, a + places]))
            if some.start == some.stop:
                continue
            rows = model[self.ids[a:a + places + self.window - 1]]
            total = sum(rows[j:places + j] for j in range(self.window))
            at = self.first[some]
            cosine = total[at - a] / np.where(self.norm[at] > 0, self.norm[at], 1)[:, None]
            low = cosine < least + 1e-8  # only those near the bound are rounded
            low[low] = np.round(cosine[low], 9) < least
            cosine[low] = 0.0
            yield some, cosine


def topic_distributions(docs: DataFrame, ctfidf_w: DataFrame, window: int = 4, stride: int = 1, min_similarity: float = 0.1,
                        per_token: bool = False, key: str = "doc_id", text: str = "text", cls: str = "topic",
                        pattern: str = TOKEN_PATTERN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, cls, prob): a document's topics by share, those above 0 (none for
    a document without a scored window). With ``per_token`` (key, pos, cls,
    score): the sum of the scores of the windows that a token is in. ``ctfidf_w``
    = (cls, term, weight, idf); the outlier class -1 is no topic."""
    model = ctfidf_w.filter(F.col(cls) != -1)
    norms = model.groupBy(cls).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    each = F.struct(F.col(cls).cast("int").alias("t"), (F.col("weight") / F.col("norm")).alias("w"))
    by_term = model.join(norms, cls).groupBy("term").agg(F.collect_list(each).alias("topics"))  # as many as topics at most
    words = ctfidf_w.select("term", "idf").distinct().join(by_term, "term", "left")

    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    total = (read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TOKEN_BYTES
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // block_tokens), min(total // 4096, cores), 1)
    # texts are shuffled once; the words of a block are listed where it lies
    of_id = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = (read.repartition(max(min(blocks, 4 * cores), blocks // 8), of_id)
                 .select("id", of_id.alias("block"), tokens("text", pattern).alias("tokens")).filter(F.size("tokens") > 0))
    wanted = dealt.select(F.col("block").alias("of"), F.explode("tokens").alias("term")).distinct().join(words, "term") \
                  .select("of", "term", "idf", F.col("topics.t").alias("t"), F.col("topics.w").alias("w"))
    kind = f"id long, pos long, `{cls}` int, score double"
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int64()), (cls, pa.int32()), ("score", pa.float64())])

    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        if not texts.num_rows or not model.num_rows:
            return schema.empty_table()
        listed = lambda t, c: pa.concat_arrays([x for x in t.column(c).chunks])
        idf = np.asarray(model["idf"], float)
        made = Windows(listed(texts, "tokens"), listed(model, "term"), idf, window, stride)
        sizes = np.asarray(pc.list_value_length(model["t"]).fill_null(0))
        word, topic = np.repeat(np.arange(len(idf)), sizes), np.asarray(pc.list_flatten(model["t"]))
        weight = np.asarray(pc.list_flatten(model["w"]), float)
        names, ids, out = np.unique(topic), np.asarray(texts["id"].fill_null(0)), []
        null = np.asarray(texts["id"].is_null())
        for lo in range(0, len(names), TOPICS_AT_ONCE):
            some = names[lo:lo + TOPICS_AT_ONCE]
            mine = np.isin(topic, some)
            dense = np.zeros((len(idf), len(some)))
            dense[word[mine], np.searchsorted(some, topic[mine])] = weight[mine]
            sums = np.zeros((len(made.ids) if per_token else len(ids), len(some)))
            for at, score in made.scores(dense * idf[:, None], min_similarity):
                if per_token:
                    for j in range(window):
                        sums[made.first[at] + j] += score
                else:
                    of = made.doc[at]
                    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    sums[of[begins]] += np.add.reduceat(score, begins, axis=0)
            doc = np.arange(len(ids))
            if per_token:
                doc = np.searchsorted(made.begin, np.arange(len(sums)), "right") - 1
                sums[np.arange(len(sums)) - made.begin[doc] >= made.size[doc]] = 0  # filled places
            row, col = np.nonzero(sums)
            out.append(pa.table([pa.array(ids[doc[row]], pa.int64(), mask=null[doc[row]]),
                                 pa.array(row - made.begin[doc[row]] if per_token else np.zeros(len(row), np.int64), pa.int64()),
                                 pa.array(some[col], pa.int32()), pa.array(sums[row, col])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    got = dealt.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(lambda t, m: run(t, m), kind)
    if per_token:
        return got.select(F.col("id").alias(key), "pos", cls, "score")
    share = F.col("score") / F.sum("score").over(Window.partitionBy("id"))  # one row per topic
    return got.select(F.col("id").alias(key), cls, share.alias("prob"))
