"""Derived stand-ins for the reference's model outputs, computed by Spark
from the driver tables (FIXTURES.md section 3).

Tag payloads: for each topic (not -1) a JSON object with the topic's
c-TF-IDF words as themes (ranks 1-7) and overarching themes (8-10), and for
each of its documents a score per tag = min(1, n / 10) where
n counts the tag word in the document. A few hand-made dirty payloads are
added (FIXTURES.md section 4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import terms
from ..sources import tables as T

# Hand-made dirty payloads (topic_id, raw JSON).
DIRTY_PAYLOADS = (
    (900, '{"topic": {"themes": ["alpha"'),
    (901, '{"topic": {"themes": ["alpha"], "overarching_themes": ["beta"]}, '
          '"texts": {"abc": {"alpha": 0.9}, "0": {"alpha": 0.8, "beta": 0.6}}}'),
    (902, '{"topic": {"themes": ["gamma"], "overarching_themes": []}, '
          '"texts": {"1": {"themes": {"gamma": 0.95, "delta": 0.6}, "overarching_themes": {"omega": 0.7}}}}'),
    (903, '{"topic": {"themes": ["x"], "overarching_themes": ["y"]}, "texts": {"2": {"zeta": 0.75}, "3": {"alpha": 0.4}}}'),
    (904, '{"topic": {"themes": ["alpha"], "overarching_themes": []}, "texts": {"3": {"alpha": 0.9}}}'),
)

#: documents of one payload row: ids that share this quotient
PAYLOAD_DOCS = 100


def topic_model(spark: SparkSession, sf: str):
    """(docs, assign, doc_counts, weights, top10) of the base topic model."""
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    assign = T.topic_assignments(spark, sf)
    from ..functions.frames import reuse
    weights = reuse(terms.ctfidf(terms.term_counts(T.labelled_documents(spark, sf), "topic", "text")))
    doc_counts = reuse(terms.document_counts(docs, "doc_id", "text"))
    top = terms.top_words(weights, k=10)
    return docs, assign, doc_counts, weights, top


def payload_texts(spark: SparkSession, sf: str, with_dirty: bool = True) -> DataFrame:
    """(topic_id, raw): JSON texts with the scores of all documents of a topic,
    as many payloads a topic as its documents need (``PAYLOAD_DOCS`` ids in
    each at most). A text is read once; the topic's words go to its documents."""
    docs = T.labelled_documents(spark, sf).filter(F.col("topic") != -1)
    top = terms.top_words(terms.ctfidf(terms.term_counts(T.labelled_documents(spark, sf), "topic", "text")), k=10)
    words = (top.filter(F.col("topic") != -1).groupBy("topic")  # ten rows a topic
                .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w")))
    q = F.lit('"')

    def score(s):
        n = F.size(F.filter("tokens", lambda t: t == s["term"]))
        return F.concat(q, s["term"], q, F.lit(": "), F.format_string("%.1f", F.least(F.lit(1.0), n / F.lit(10.0))))

    per_doc = (docs.select("doc_id", "topic", tokens("text").alias("tokens")).join(words, "topic")
                   .select("topic", "w", F.floor(F.col("doc_id") / PAYLOAD_DOCS).alias("part"), "doc_id",
                           F.concat(q, F.col("doc_id").cast("string"), q, F.lit(": {"),
                                    F.array_join(F.transform("w", score), ", "), F.lit("}")).alias("dj")))
    listed = lambda keep: F.array_join(F.transform(F.filter("w", keep), lambda s: F.concat(q, s["term"], q)), ", ")
    raw = (per_doc.groupBy("topic", "part", "w").agg(F.array_sort(F.collect_list(F.struct("doc_id", "dj"))).alias("d"))
                  .select(F.col("topic").cast("int").alias("topic_id"),
                          F.concat(F.lit('{"topic": {"themes": ['), listed(lambda s: s["rank"] <= 7),
                                   F.lit('], "overarching_themes": ['), listed(lambda s: s["rank"] > 7), F.lit(']}, "texts": {'),
                                   F.array_join(F.transform("d", lambda s: s["dj"]), ", "), F.lit("}}")).alias("raw")))
    if with_dirty:
        dirty = spark.createDataFrame(list(DIRTY_PAYLOADS), "topic_id int, raw string")
        raw = raw.unionByName(dirty)
    return raw
