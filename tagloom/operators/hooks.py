"""Hooks (2.12): models, tokenizers, representations and metrics of a user's own.

Each is a function on DataFrames, so what is plugged in stays part of the plan:

* model(docs) -> (doc_id, topic), one row per document;
* tokenizer: a Python UDTF (text) -> rows (pos, term), see ``term_rows``;
* representation(topic_words, occurrences, topics) -> topic_words, with
  topic_words = (topic, rank, term, weight), occurrences = (doc_id, pos, term)
  and topics the model's table; representations form a chain;
* metric(topic_words, occurrences) -> one row with one number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS
from ..session import cut_lineage
from . import quality, terms

Model = Callable[[DataFrame], DataFrame]
Representation = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
Metric = Callable[[DataFrame, DataFrame], DataFrame]


@F.udtf(returnType="pos: int, term: string")
class WordRows:
    """The words of a text without English stop words, lower-cased: letters,
    digits and underscores, two or more. A null text has none."""

    WORD = re.compile(r"\w{2,}")

    def eval(self, text: str):
        kept = (w for w in self.WORD.findall((text or "").lower()) if w not in ENGLISH_STOP_WORDS)
        yield from enumerate(kept)


def term_rows(docs: DataFrame, tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term) by a row-expanding tokenizer (a UDTF): a lateral join,
    worked out where the texts are, without a shuffle."""
    return docs.select(key, text).lateralJoin(tokenizer(F.col(text).outer())).select(key, "pos", "term")


def evaluate(docs: DataFrame, model: Model, representations: Sequence[Representation] = (),
             metrics: Mapping[str, Metric] | None = None, tokenizer=WordRows, k: int = 10,
             key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Topics by ``model``, their ``k`` words of highest c-TF-IDF, the chain of
    representations over them in order, and each metric of the outcome ->
    (topic_words, scores(metric, value)). The outlier topic -1 has words, but
    metrics do not see it. Tokens are made once and written; words of a topic
    are a small table, written after the chain as every metric reads it."""
    topics = model(docs).select(key, "topic")
    rows = cut_lineage(term_rows(docs, tokenizer, key, text))
    counts = rows.join(topics, key).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    words = terms.top_words(terms.ctfidf(counts), k=k).select("topic", "rank", "term", "weight")
    for step in representations:
        words = step(words, rows, topics)
    words = cut_lineage(words)
    real = words.filter("topic <> -1")
    scores = None
    for name, metric in (metrics or {}).items():
        one = metric(real, rows)
        one = one.select(F.lit(name).alias("metric"), F.col(one.columns[0]).cast("double").alias("value"))
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        scores = words.sparkSession.createDataFrame([], "metric string, value double")
    return words, scores


def spread_words(min_share: float) -> Representation:
    """Keeps the words that stand in at least ``min_share`` of the topic's
    documents and closes the ranks up. A topic may lose all its words."""
    def step(words: DataFrame, rows: DataFrame, topics: DataFrame) -> DataFrame:
        # only the topics' words are joined; the list is rank x topics long
        seen = rows.join(words.select("term").distinct(), "term", "left_semi").select("doc_id", "term").distinct() \
                   .join(topics, "doc_id").groupBy("topic", "term").agg(F.count(F.lit(1)).alias("docs"))
        sizes = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
        kept = words.join(seen, ["topic", "term"]).join(sizes, "topic").filter(F.col("docs") >= F.col("size") * min_share)
        return _closed(kept)
    return step


def own_words(max_topics: int) -> Representation:
    """Drops the words listed by more than ``max_topics`` topics and closes the
    ranks up, so that topics are told by words of their own."""
    def step(words: DataFrame, rows: DataFrame, topics: DataFrame) -> DataFrame:
        shared = words.groupBy("term").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > max_topics)
        return _closed(words.join(shared, "term", "left_anti"))
    return step


def first_words(k: int) -> Representation:
    """The first ``k`` words of every topic."""
    return lambda words, rows, topics: words.filter(F.col("rank") <= k)


def _closed(words: DataFrame) -> DataFrame:
    """Ranks 1, 2, ... again; a topic's words are at most the ``k`` of ``evaluate``."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy("rank"))
    return words.select("topic", place.alias("rank"), "term", "weight")


def diversity(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct words over all listed words (topics may list unlike numbers);
    null without words."""
    return words.agg(F.try_divide(F.countDistinct("term"), F.count(F.lit(1))).alias("diversity"))


def coherence(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean NPMI of the topics over documents with a word."""
    return quality.npmi(words, rows, mode="document").agg(F.avg("npmi").alias("npmi"))


def coverage(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with a listed word of any topic, over documents with a word."""
    hit = rows.join(words.select("term").distinct().withColumn("hit", F.lit(1)), "term", "left")
    per = hit.groupBy("doc_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg(F.avg("hit").alias("coverage"))
