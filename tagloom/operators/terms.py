"""Bag of words, TF-IDF, class-based TF-IDF and top words.

Tables are long: (key, term, n) and (key, term, weight). Each step is a
groupBy with map-side partial aggregation or a window whose partitions are
bounded by the number of classes, never by corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import reuse, top_k
from ..functions.text import ENGLISH_STOP_WORDS, TOKEN_PATTERN, drop_words, ngrams, tokens
from ..session import cut_lineage


def doc_terms(df: DataFrame, key: str, text: str, stop_words=ENGLISH_STOP_WORDS,
              ngram_max: int = 1, pattern: str = TOKEN_PATTERN, tokenizer=None) -> DataFrame:
    """(key, term) one row per occurrence, after stop words, then n-grams.
    ``tokenizer`` (text column -> array column) overrides ``pattern``."""
    toks = tokenizer(text) if tokenizer is not None else tokens(text, pattern)
    words = df.select(F.col(key), drop_words(toks, stop_words).alias("__words"))  # worked out once a text, not once a pair
    return words.select(F.col(key), F.explode(ngrams("__words", ngram_max)).alias("term"))


def term_counts(df: DataFrame, key: str, text: str, stop_words=ENGLISH_STOP_WORDS,
                ngram_max: int = 1, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """A1: (key, term, n) occurrences of each term per key (document or class)."""
    return (doc_terms(df, key, text, stop_words, ngram_max, pattern)
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")))


def document_counts(df: DataFrame, key: str, text: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """A1 per document: the rows of ``term_counts`` for keys of a few texts each.

    Texts are shuffled by key, not the many more (key, term) pairs; a key's
    words are sorted and counted by runs in its row. The result stays dealt by
    key, so later windows and groups by key need no shuffle.
    """
    texts = df.select(F.col(key), F.col(text).alias("__text")).repartition(key)
    words = (texts.select(key, drop_words(tokens("__text"), stop_words).alias("__w")).groupBy(key)
                  .agg(F.sort_array(F.flatten(F.collect_list("__w"))).alias("__w")).filter(F.size("__w") > 0))
    last = F.filter(F.sequence(F.lit(1), F.size("__w")),
                    lambda i: (i == F.size("__w")) | (F.get("__w", i) != F.get("__w", i - 1)))
    runs = words.select(key, "__w", last.alias("__last"))  # places of the last of each run of equal words
    term = F.transform("__last", lambda i, nth: F.struct(
        F.get("__w", i - 1).alias("term"),
        (i - F.when(nth == 0, 0).otherwise(F.get("__last", nth - 1))).cast("long").alias("n")))
    return runs.select(key, F.explode(term).alias("__t")).select(key, "__t.term", "__t.n")


def tfidf(counts: DataFrame, key: str = "doc_id", n_docs: int | None = None) -> DataFrame:
    """A2: smoothed TF-IDF, L2-normalised per key -> (key, term, weight, df).

    w = n * (ln((1+N)/(1+df)) + 1), then divided by the key's L2 norm.
    N = ``n_docs`` (all documents, also those without terms) or, when not
    given, the number of keys with terms. Keys without terms have no rows.
    """
    counts = reuse(counts)
    if n_docs is None:
        # one scalar through the driver: the number of keys
        n_docs = counts.select(F.countDistinct(key)).first()[0]
    # df per term via partial aggregation, written so that its size is known: a
    # small table is sent to the counts, which then are not shuffled by term; of
    # a large one the join back is skew-split by AQE
    dfreq = cut_lineage(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    raw = (counts.join(dfreq, "term")
                 .select(key, "term", "df",
                         (F.col("n") * (F.log(F.lit(1.0 + n_docs) / (F.lit(1) + F.col("df"))) + 1))
                         .alias("w")))
    # the norm window holds one document's distinct terms (bounded by its length)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"), "df")


def ctfidf(counts: DataFrame, cls: str = "topic", l1: bool = True,
           reduce_frequent: bool = False) -> DataFrame:
    """A3: class-based TF-IDF. counts = (cls, term, n) summed over the class.

    weight = tf(t,c) * ln(1 + A / f(t)), with tf L1-normalised per class
    (optional), optionally square-rooted, f(t) the term's frequency over all
    classes and A the integer part of the mean number of words per class.
    """
    counts = reuse(counts)
    totals = counts.groupBy(cls).agg(F.sum("n").alias("total"))
    # one row per class; the global window is bounded by the number of classes
    totals = totals.withColumn("A", F.floor(F.avg("total").over(Window.partitionBy())))
    # per-term frequency over classes: partitions hold at most one row per class
    per_term = counts.withColumn("f", F.sum("n").over(Window.partitionBy("term")))
    tf = F.col("n") / F.col("total") if l1 else F.col("n").cast("double")
    if reduce_frequent:
        tf = F.sqrt(tf)
    idf = F.log(F.col("A") / F.col("f") + F.lit(1))
    # sent to the terms: by class the terms would lie in as many tasks as classes
    return (per_term.join(F.broadcast(totals), cls)
                    .select(cls, "term", "n", idf.alias("idf"), (tf * idf).alias("weight")))


def top_words(weights: DataFrame, cls: str = "topic", k: int = 10,
              weight: str = "weight") -> DataFrame:
    """A4: top-k terms per class by weight, ties by term; rank 1..k."""
    return top_k(weights, [cls], [F.col(weight).desc(), F.col("term").asc()], k)


def positions(df: DataFrame, key: str, text: str, stop_words=ENGLISH_STOP_WORDS,
              pattern: str = TOKEN_PATTERN, length: bool = False) -> DataFrame:
    """(key, pos, term): token positions (from 0) after stop-word removal;
    with ``length`` also L, the number of the document's tokens."""
    words = df.select(F.col(key), drop_words(tokens(text, pattern), stop_words).alias("__words"))
    L = [F.size("__words").alias("L")] if length else []
    return words.select(F.col(key), *L, F.posexplode("__words").alias("pos", "term"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, n, docs) corpus counts from per-document counts."""
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def class_counts(docs: DataFrame, assign: DataFrame, key: str = "doc_id", text: str = "text",
                 cls: str = "topic", stop_words=ENGLISH_STOP_WORDS, ngram_max: int = 1) -> DataFrame:
    """(cls, term, n) for documents joined to their class.

    The join is on the document key before tokenising: shuffling the text
    once is cheaper than shuffling (doc, term, n) rows, which outnumber it.
    """
    joined = docs.select(key, text).join(assign.select(key, cls), key)
    return term_counts(joined, cls, text, stop_words, ngram_max)
