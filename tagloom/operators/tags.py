"""Prompts, token budgets, tag payloads and tag selection
(P11, A14, A15, J4, J6, J7, F6, F7, W5, U4, A20).

Every per-topic or per-document list is built from an already bounded set
(top-k words, top-n representative documents, one document's tags); no
operator collects a whole topic's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import reuse, top_k

# Template placeholders and the document bullet format.
KEYWORDS = "[KEYWORDS]"
DOCUMENTS = "[DOCUMENTS]"
IDS = "[IDS]"


def word_count(text) -> Column:
    """Token count used for budgets: whitespace-separated words."""
    t = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def truncate_words(text, n: int) -> Column:
    """The first n whitespace words of a text (unchanged when shorter)."""
    t = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(word_count(t) <= n, t).otherwise(F.array_join(F.slice(F.split(trimmed, r"\s+"), 1, n), " "))


def fit_budget(ranked: DataFrame, max_tokens: int, cls: str = "topic", rank: str = "rank",
               tokens: str = "tokens") -> DataFrame:
    """Keep each class's ranked prefix whose running token total stays
    within ``max_tokens``; the first document that overflows ends the prefix
    (counts are >= 0, so a running sum <= budget is exactly that prefix)."""
    w = Window.partitionBy(cls).orderBy(F.col(rank)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("__run", F.sum(tokens).over(w)).filter(F.col("__run") <= max_tokens).drop("__run")


def build_prompts(top_words: DataFrame, rep_docs: DataFrame, template: str, cls: str = "topic",
                  term: str = "term", rank: str = "rank", doc: str = "doc") -> DataFrame:
    """Fill a template per topic.

    [KEYWORDS] -> ranked words joined by ', '; [DOCUMENTS] -> '- doc\\n---\\n'
    per ranked document; [IDS] -> ids parsed from each document's first line
    ('ID: n'), joined by ', '.
    """
    kw = (top_words.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(rank, term))).alias("__k"))
                   .select(cls, F.array_join(F.transform("__k", lambda s: s[term]), ", ").alias("__kw")))
    docs = (rep_docs.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(rank, doc))).alias("__d"))
                    .select(cls,
                            F.array_join(F.transform("__d", lambda s: F.concat(F.lit("- "), s[doc], F.lit("\n---\n"))), "")
                            .alias("__docs"),
                            F.array_join(F.transform("__d", lambda s: F.element_at(
                                F.split(F.element_at(F.split(s[doc], "\n"), 1), ": "), 2)), ", ").alias("__ids")))
    j = kw.join(docs, cls, "full")
    p = F.lit(template)
    if KEYWORDS in template:
        p = F.replace(p, F.lit(KEYWORDS), F.coalesce(F.col("__kw"), F.lit("")))
    if DOCUMENTS in template:
        p = F.replace(p, F.lit(DOCUMENTS), F.coalesce(F.col("__docs"), F.lit("")))
    if IDS in template:
        p = F.replace(p, F.lit(IDS), F.coalesce(F.col("__ids"), F.lit("")))
    return j.select(cls, p.alias("prompt"))


# -- payloads --------------------------------------------------------------------

NESTED_KINDS = ("themes", "overarching_themes")


def payload_entries(payloads: DataFrame, topic: str = "topic_id", payload: str = "payload") -> DataFrame:
    """Explode parsed payloads to (topic, dataset_id, tag, score, nested_kind).

    Keys that are not integers are skipped. A value that is an object under
    the key 'themes' or 'overarching_themes' is flattened into that kind.
    """
    e = payloads.select(F.col(topic).alias("topic"),
                        F.explode(F.col(payload + ".texts")).alias("doc_key", "tags"))
    e = e.withColumn("dataset_id", F.expr("try_cast(doc_key AS BIGINT)")).filter(F.col("dataset_id").isNotNull())
    t = e.select("topic", "dataset_id", F.explode("tags").alias("tag", "value"))
    nested = (t.filter(F.col("tag").isin(*NESTED_KINDS))
               .select("topic", "dataset_id", F.col("tag").alias("nested_kind"),
                       F.explode(F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))).alias("tag", "score")))
    flat = (t.filter(~F.col("tag").isin(*NESTED_KINDS))
             .select("topic", "dataset_id", "tag", F.expr("try_cast(value AS DOUBLE)").alias("score"),
                     F.lit(None).cast("string").alias("nested_kind")))
    return flat.unionByName(nested.select("topic", "dataset_id", "tag", "score", "nested_kind"))


def topic_lists(payloads: DataFrame, topic: str = "topic_id", payload: str = "payload") -> DataFrame:
    """(topic, tag, listed_kind) from each payload's theme lists; a tag in
    both lists counts as a theme."""
    th = payloads.select(F.col(topic).alias("topic"), F.explode(F.col(payload + ".topic.themes")).alias("tag")) \
                 .withColumn("listed_kind", F.lit("themes"))
    ov = payloads.select(F.col(topic).alias("topic"),
                         F.explode(F.col(payload + ".topic.overarching_themes")).alias("tag")) \
                 .withColumn("listed_kind", F.lit("overarching_themes"))
    both = th.unionByName(ov)
    return (both.groupBy("topic", "tag")
                .agg(F.max(F.when(F.col("listed_kind") == "themes", 2).otherwise(1)).alias("__k"))
                .select("topic", "tag", F.when(F.col("__k") == 2, "themes")
                        .otherwise("overarching_themes").alias("listed_kind")))


def classify_tags(payloads: DataFrame, topic: str = "topic_id", payload: str = "payload",
                  duplicate: str = "max") -> DataFrame:
    """(dataset_id, kind, tag, score).

    kind: nested kind if the value was nested; else 'themes' if the tag is in
    the topic's themes, 'overarching_themes' if in its overarching list,
    otherwise 'themes'. The same (document, kind, tag) from several topics
    keeps the largest score (``duplicate='max'``) or the one from the largest
    topic id (``'last'``).
    """
    payloads = reuse(payloads)  # one row per topic, read by two branches
    e = payload_entries(payloads, topic, payload)
    lists = topic_lists(payloads, topic, payload)
    j = e.join(lists, ["topic", "tag"], "left")
    kind = F.coalesce(F.col("nested_kind"), F.col("listed_kind"), F.lit("themes"))
    rows = j.select("dataset_id", kind.alias("kind"), "tag", "score", "topic")
    if duplicate == "max":
        return rows.groupBy("dataset_id", "kind", "tag").agg(F.max("score").alias("score"))
    return (rows.groupBy("dataset_id", "kind", "tag")
                .agg(F.max_by("score", "topic").alias("score")))


def doc_topics(payloads: DataFrame, topic: str = "topic_id", payload: str = "payload") -> DataFrame:
    """(dataset_id, topic) for every integer key of every payload."""
    e = payloads.select(F.col(topic).alias("topic"), F.explode(F.map_keys(F.col(payload + ".texts"))).alias("k"))
    return (e.select(F.expr("try_cast(k AS BIGINT)").alias("dataset_id"), "topic")
             .filter(F.col("dataset_id").isNotNull()).distinct())


def missing_ids(docs: DataFrame, found: DataFrame, id_col: str = "dataset_id") -> DataFrame:
    """Ids of ``docs`` that no payload mentions."""
    return docs.select(id_col).join(found.select(id_col).distinct(), id_col, "left_anti")


def threshold_tags(tags: DataFrame, minimum: dict[str, float], kind: str = "kind",
                   score: str = "score") -> DataFrame:
    """keep tags whose score exceeds the minimum of their kind
    (kinds without a minimum are kept)."""
    cond = None
    for k, m in minimum.items():
        c = (F.col(kind) == k) & (F.col(score) > m)
        cond = c if cond is None else (cond | c)
    others = ~F.col(kind).isin(*minimum.keys())
    return tags.filter(cond | others if cond is not None else others)


def select_labels(scores: DataFrame, min_prob: float = 0.5, multi_label: bool = True,
                  key: str = "doc_id", label: str = "label", score: str = "score") -> DataFrame:
    """multi-label: every label above ``min_prob``, or the best one when
    none is; single-label: the best one. Ties by label."""
    scores = reuse(scores)  # read by the best-label and the above-threshold branches
    best = top_k(scores, [key], [F.col(score).desc(), F.col(label).asc()], 1, "__rn").drop("__rn")
    if not multi_label:
        return best
    above = scores.filter(F.col(score) > min_prob)
    none_above = best.join(above.select(key).distinct(), key, "left_anti")
    return above.unionByName(none_above.select(*scores.columns))


def ordered_distinct(tags: DataFrame, key: str = "doc_id", tag: str = "tag", pos: str = "pos") -> DataFrame:
    """(key, tags array) distinct tags in first-seen order per key."""
    first = tags.groupBy(key, tag).agg(F.min(pos).alias("__p"))
    return (first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", tag))).alias("__t"))
                 .select(key, F.transform("__t", lambda s: s[tag]).alias("tags")))


def candidate_tags(doc_topics_: DataFrame, topic_tags: DataFrame, key: str = "doc_id",
                   topic: str = "topic", tag: str = "tag") -> DataFrame:
    """Distinct (document, tag) from the tags of each document's topics."""
    return doc_topics_.select(key, topic).join(topic_tags.select(topic, tag), topic).select(key, tag).distinct()


def common_tags(tags: DataFrame, pairs: DataFrame, key: str = "doc_id", tag: str = "tag") -> DataFrame:
    """U4: tags shared by the two documents of each (a, b) pair."""
    ta = tags.select(F.col(key).alias("a"), F.col(tag).alias("tag")).distinct()
    tb = tags.select(F.col(key).alias("b"), F.col(tag).alias("tag")).distinct()
    return pairs.select("a", "b").join(ta, "a").join(tb, ["b", "tag"]).select("a", "b", "tag")


def shared_tags(a: DataFrame, b: DataFrame, key: str = "doc_id", tag: str = "tag") -> DataFrame:
    """U4: (key, tag) present in both tag tables (e.g. predicted and actual)."""
    return a.select(key, tag).distinct().join(b.select(key, tag).distinct(), [key, tag])


def tag_shares(tags: DataFrame, kind: str = "kind", tag: str = "tag") -> DataFrame:
    """Per (kind, tag) frequency and its share (%) of the kind's rows."""
    f = tags.groupBy(kind, tag).agg(F.count(F.lit(1)).alias("n"))
    tot = tags.groupBy(kind).agg(F.count(F.lit(1)).alias("__tot"))
    return f.join(tot, kind).select(kind, tag, "n", (F.col("n") * 100.0 / F.col("__tot")).alias("share"))


def score_histogram(tags: DataFrame, bins: int = 10, kind: str = "kind", score: str = "score") -> DataFrame:
    """Tag scores in equal bins over [0, 1] per kind."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return tags.groupBy(kind, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
