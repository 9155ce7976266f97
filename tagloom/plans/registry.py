"""Named queries over the driver tables: (spark, sf_dir) -> DataFrame.

Each wires fixture projections (sources.tables) to library operators and
aliases every output column to the name used by the matching oracle SQL.
Floats are rounded to 6 digits; integers are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import r6
from ..operators import terms
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# -- topics and words -------------------------------------------------------

def _topic_weights(spark, sf):
    counts = terms.term_counts(T.labelled_documents(spark, sf), "topic", "text")
    return terms.ctfidf(counts)


@query("ctfidf_top_words")
def q_ctfidf_top_words(spark, sf):
    top = terms.top_words(_topic_weights(spark, sf), k=10)
    return top.select(F.col("topic").cast("bigint").alias("topic"), "rank",
                      F.col("term").alias("word"), r6("weight").alias("weight"))


# -- sources, augmentation, cleaning, filters --------------------------------

from ..operators import augment as AU  # noqa: E402
from ..operators import clean as CL  # noqa: E402

EXCLUDED_IDS = (4537, 4546, 4562)  # fixed values: known non-dataset ids


def _catalogue(spark, sf):
    return T.load_catalogue(spark, sf)


def _scraped(spark, sf):
    pages = T.table(spark, sf, "pages")
    src = pages.select(F.col("page_id").alias("dataset_id"), CL.html_text("html").alias("scraped_data"),
                       F.col("page_id").alias("ord"))
    return AU.latest_scraped([src], order="ord")


def _desc(df):
    return df.select("dataset_id", "augmented_description")


@query("catalogue_load")
def q_catalogue_load(spark, sf):
    c = _catalogue(spark, sf)
    return c.select("dataset_id", "name", "description", F.array_join("tag", ",").alias("tags"),
                    F.size("features").cast("bigint").alias("n_features"))


@query("exclude_ids")
def q_exclude_ids(spark, sf):
    c = _catalogue(spark, sf)
    return c.filter(~F.col("dataset_id").isin(list(EXCLUDED_IDS))).select("dataset_id", "name")


@query("augment_name")
def q_augment_name(spark, sf):
    return _desc(_catalogue(spark, sf).transform(AU.with_name()))


@query("augment_tags")
def q_augment_tags(spark, sf):
    rm = T.tag_removals(spark, sf)
    return _desc(_catalogue(spark, sf).transform(AU.with_tags(removals=rm)))


@query("augment_features")
def q_augment_features(spark, sf):
    return _desc(_catalogue(spark, sf).transform(AU.with_features(max_features=10)))


@query("augment_id")
def q_augment_id(spark, sf):
    return _desc(_catalogue(spark, sf).transform(AU.with_id()))


@query("augment_scraped")
def q_augment_scraped(spark, sf):
    d = _catalogue(spark, sf).transform(AU.with_scraped(_scraped(spark, sf)))
    return d.select("dataset_id", "scraped_data", "augmented_description")


@query("augment_all")
def q_augment_all(spark, sf):
    rm = T.tag_removals(spark, sf)
    steps = [AU.with_id(), AU.with_name(), AU.with_tags(removals=rm),
             AU.with_features(max_features=10), AU.with_scraped(_scraped(spark, sf))]
    return _desc(AU.augment(_catalogue(spark, sf), steps))


@query("attach_rewrites")
def q_attach_rewrites(spark, sf):
    d = _catalogue(spark, sf).transform(AU.with_rewrites(T.rewrites(spark, sf)))
    return d.select("dataset_id", "prompt_description")


@query("rewrite_prompts")
def q_rewrite_prompts(spark, sf):
    d = AU.rewrite_prompts(_catalogue(spark, sf))
    return d.select("dataset_id", "rewrite_prompt")


@query("repair_urls")
def q_repair_urls(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", "url")
    mapping = (pages.filter(F.col("url").contains("#"))
                    .select(F.col("url").alias("from_url"),
                            F.regexp_replace("url", "#.*$", "").alias("to_url")))
    return AU.repair_urls(pages, mapping)


@query("clean_text")
def q_clean_text(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", CL.clean_newlines_lower("text").alias("clean"))


@query("squash_whitespace")
def q_squash_ws(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", CL.squash_whitespace("text").alias("squashed"))


@query("paragraphs")
def q_paragraphs(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    return CL.paragraphs(d).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "paragraph")


@query("chunks")
def q_chunks(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", CL.squash_whitespace("text").alias("text"))
    return d.select("doc_id", F.posexplode(CL.chunks("text", 500)).alias("pos", "chunk")) \
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk")


@query("html_text")
def q_html_text(spark, sf):
    p = T.table(spark, sf, "pages")
    return p.select("page_id", CL.html_text("html").alias("text"))


@query("route_by_domain")
def q_route_by_domain(spark, sf):
    from ..sources import files as SF
    p = T.table(spark, sf, "pages").select("page_id", "url")
    return SF.route_by_domain(p, "url", {"com": ".example.com", "net": ".example.net",
                                         "org": ".example.org"}).select("page_id", "site")


@query("drop_short")
def q_drop_short(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    kept, dropped = CL.drop_short(d, "text", 2)
    return kept.select("doc_id", F.lit(1).cast("bigint").alias("kept")).unionByName(
        dropped.select("doc_id", F.lit(0).cast("bigint").alias("kept")))


@query("drop_flagged")
def q_drop_flagged(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "event_type", "props")
    return CL.drop_flagged(e, "event_type", "error", "props").select("event_id")


@query("min_length")
def q_min_length(spark, sf):
    return CL.min_length(_catalogue(spark, sf), "description", 100).select("dataset_id")


@query("keep_domains")
def q_keep_domains(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", "url")
    return CL.keep_domains(p, "url", [".example.com", ".example.org"]).select("page_id", "url")


@query("align_embeddings")
def q_align_embeddings(spark, sf):
    kept = CL.min_length(_catalogue(spark, sf), "description", 100).select(F.col("dataset_id").alias("doc_id"))
    return CL.align(T.vectors(spark, sf), kept, "doc_id").select("doc_id", F.col("label").cast("bigint").alias("label"))


@query("backlog")
def q_backlog(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id")
    e = T.vectors(spark, sf).select("doc_id")
    return CL.align(d, e, "doc_id", keep=False)


def _doc_tokens(spark, sf, stop=True):
    from ..functions.text import ENGLISH_STOP_WORDS, alpha_tokens
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    return terms.doc_terms(d, "doc_id", "text", ENGLISH_STOP_WORDS if stop else (), tokenizer=alpha_tokens)


@query("limit_vocabulary")
def q_limit_vocabulary(spark, sf):
    t = CL.limit_vocabulary(_doc_tokens(spark, sf), 2000)
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def _word_tokens(spark, sf, stop=True):
    from ..functions.text import ENGLISH_STOP_WORDS
    return terms.doc_terms(_docs(spark, sf), "doc_id", "text", ENGLISH_STOP_WORDS if stop else ())


@query("min_count")
def q_min_count(spark, sf):
    t = CL.min_count(_word_tokens(spark, sf), 50)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("remove_stopwords")
def q_remove_stopwords(spark, sf):
    from ..functions.text import ENGLISH_STOP_WORDS
    sw = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "term string")
    return CL.remove_stopwords(_word_tokens(spark, sf, stop=False), sw).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@query("fill_oov")
def q_fill_oov(spark, sf):
    """topic words and pairs of words against the words of the corpus."""
    from ..functions.text import tokens
    counts = terms.class_counts(_docs(spark, sf), T.topic_assignments(spark, sf), ngram_max=2)
    top = terms.top_words(terms.ctfidf(counts), k=10)
    words = _docs(spark, sf).select("doc_id", F.posexplode(tokens("text")).alias("pos", "term"))
    first = words.transform(CL.first_token).first()[0]
    out = CL.fill_oov(top, words.select("term"), first)
    return out.select(F.col("topic").cast("bigint").alias("topic"), "rank", "term")


@query("exact_dedupe")
def q_exact_dedupe(spark, sf):
    d = T.table(spark, sf, "documents").select("text")
    return CL.exact_dedupe(d, ["text"]).select(F.sha2("text", 256).alias("text_hash"))


# -- TF-IDF, similarity join, near-duplicate removal --------------------------

from ..operators import dedupe as DD  # noqa: E402

DEDUPE_T = 0.99
PAIRS_T = 0.9


def _docs(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "text")


@query("tfidf_weights")
def q_tfidf_weights(spark, sf):
    w = DD.vectors(_docs(spark, sf))
    return w.select("doc_id", "term", r6("weight").alias("weight"))


@query("twin_groups")
def q_twin_groups(spark, sf):
    return DD.twin_groups(_docs(spark, sf))


@query("similar_pairs")
def q_similar_pairs(spark, sf):
    """Pairs between representatives and, as pairs of cosine 1, the
    membership: every other member of a class with its representative."""
    pairs, groups = DD.representative_pairs(_docs(spark, sf), PAIRS_T)
    members = groups.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("cosine"))
    return pairs.select("a", "b", r6("cosine").alias("cosine")).unionByName(members)


@query("similar_documents")
def q_similar_documents(spark, sf):
    """One row per document with its class and its number of links."""
    docs = _docs(spark, sf)
    pairs, groups = DD.representative_pairs(docs, PAIRS_T)
    return DD.similar_documents(docs, cut_lineage(pairs), groups)


def _dedupe(spark, sf):
    return DD.drop_similar(_docs(spark, sf), DEDUPE_T)


@query("drop_similar_kept")
def q_drop_similar_kept(spark, sf):
    kept, _ = _dedupe(spark, sf)
    return kept.select("doc_id")


@query("drop_similar_pairs")
def q_drop_similar_pairs(spark, sf):
    _, similar = _dedupe(spark, sf)
    return similar.select("kept_id", "similar_id")


# -- topic quality and topic tables ------------------------------------------

from ..operators import blocks as BK  # noqa: E402
from ..operators import quality as QU  # noqa: E402
from ..operators import topics as TP  # noqa: E402


def _topic_words(spark, sf, k=10):
    top = terms.top_words(_topic_weights(spark, sf), k=k)
    return top.filter(F.col("topic") != -1)


def _positions(spark, sf):
    return terms.positions(_docs(spark, sf), "doc_id", "text", length=True)


def _lengths(spark, sf):
    from ..functions.text import ENGLISH_STOP_WORDS, drop_words, tokens
    return _docs(spark, sf).select("doc_id", F.size(drop_words(tokens("text"), ENGLISH_STOP_WORDS)).alias("L"))


@query("npmi_window")
def q_npmi_window(spark, sf):
    s = QU.npmi(_topic_words(spark, sf), _positions(spark, sf), mode="window", window=10,
                lengths=_lengths(spark, sf))
    return s.select(F.col("topic").cast("bigint").alias("topic"), r6("npmi").alias("npmi"))


@query("npmi_document")
def q_npmi_document(spark, sf):
    s = QU.npmi(_topic_words(spark, sf), _positions(spark, sf), mode="document",
                lengths=_lengths(spark, sf))
    return s.select(F.col("topic").cast("bigint").alias("topic"), r6("npmi").alias("npmi"))


@query("diversity")
def q_diversity(spark, sf):
    return QU.diversity(_topic_words(spark, sf), k=10).select(r6("diversity").alias("diversity"))


@query("weighted_quality")
def q_weighted_quality(spark, sf):
    coh = QU.npmi(_topic_words(spark, sf), _positions(spark, sf), mode="window",
                  lengths=_lengths(spark, sf)).agg(F.avg("npmi").alias("npmi"))
    div = QU.diversity(_topic_words(spark, sf), k=10)
    # two one-row results side by side: union + max, no join needed
    both = (coh.select("npmi", F.lit(None).cast("double").alias("diversity"))
               .unionByName(div.select(F.lit(None).cast("double").alias("npmi"), "diversity"))
               .agg(F.max("npmi").alias("npmi"), F.max("diversity").alias("diversity")))
    lc, ld, w = QU.weighted_quality_cols("npmi", "diversity")
    return both.select(r6("npmi").alias("npmi"), r6("diversity").alias("diversity"),
                       r6(lc).alias("log_coherence"), r6(ld).alias("log_diversity"), r6(w).alias("weighted"))


def _vectors(spark, sf):
    return T.vectors(spark, sf)


@query("silhouette_samples")
def q_silhouette_samples(spark, sf):
    s = QU.silhouette_samples(_vectors(spark, sf))
    return s.select("doc_id", F.col("label").cast("bigint").alias("label"), r6("s").alias("s"))


@query("silhouette")
def q_silhouette(spark, sf):
    return QU.silhouette(_vectors(spark, sf)).select(r6("silhouette").alias("silhouette"))


def _centroids(spark, sf):
    return TP.centroids(_vectors(spark, sf), cls="label")


@query("centroids")
def q_centroids(spark, sf):
    c = _centroids(spark, sf)
    return c.select(F.col("label").cast("bigint").alias("topic"), F.posexplode("centroid").alias("i", "value")) \
            .select("topic", F.col("i").cast("bigint").alias("i"), r6("value").alias("value"))


@query("simplified_silhouette")
def q_simplified_silhouette(spark, sf):
    c = TP.centroids(_vectors(spark, sf), cls="label", normalize=False)
    s = QU.simplified_silhouette(_vectors(spark, sf), c)
    return s.agg(F.avg("s").alias("s")).select(r6("s").alias("silhouette"))


@query("nearest_topic")
def q_nearest_topic(spark, sf):
    n = TP.nearest(_vectors(spark, sf), _centroids(spark, sf), cls="label")
    return n.select("doc_id", F.col("label").cast("bigint").alias("topic"), r6("cosine").alias("cosine"))


def _membership(spark, sf):
    return TP.membership(_vectors(spark, sf), _centroids(spark, sf), cls="label").withColumnRenamed("label", "topic")


@query("membership")
def q_membership(spark, sf):
    m = _membership(spark, sf)
    return m.select("doc_id", F.col("topic").cast("bigint").alias("topic"), r6("prob").alias("prob"))


@query("top_topics")
def q_top_topics(spark, sf):
    t = TP.top_topics(_membership(spark, sf), k=2)
    return t.select("doc_id", F.col("topic").cast("bigint").alias("topic"), "rank")


@query("topic_info")
def q_topic_info(spark, sf):
    info = TP.topic_info(T.topic_assignments(spark, sf), terms.top_words(_topic_weights(spark, sf), k=10))
    return info.select(F.col("topic").cast("bigint").alias("topic"), "count", "name", "representation")


@query("rank_topics")
def q_rank_topics(spark, sf):
    r = TP.rank_topics(TP.topic_sizes(T.topic_assignments(spark, sf)))
    return r.select(F.col("topic").cast("bigint").alias("topic"), "count", F.col("new_topic").cast("bigint").alias("new_topic"))


def _topic_blocks(spark, sf):
    """The documents in blocks and the c-TF-IDF weights of their topics, stored."""
    blocks = BK.WordBlocks(_docs(spark, sf))
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    counts = cut_lineage(TP.block_counts(blocks, TP.block_classes(blocks, e, default=-1)))
    return blocks, cut_lineage(terms.ctfidf(counts))


@query("representative_docs")
def q_representative_docs(spark, sf):
    counts = terms.document_counts(_docs(spark, sf), "doc_id", "text")
    r = TP.representative_members(counts, _topic_weights(spark, sf), T.topic_assignments(spark, sf), n=4)
    return r.select(F.col("topic").cast("bigint").alias("topic"), "rank", "doc_id", r6("cosine").alias("cosine"))


@query("reassign_outliers")
def q_reassign_outliers(spark, sf):
    assign = T.topic_assignments(spark, sf)
    blocks, weights = _topic_blocks(spark, sf)
    out = cut_lineage(TP.reassign_outliers(assign, TP.block_candidates(blocks, weights, assign.filter("topic = -1"))))
    blocks.drop()
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"))


@query("reassigned_words")
def q_reassigned_words(spark, sf):
    """M5 then A3: top words recomputed once the outliers have moved."""
    assign = T.topic_assignments(spark, sf)
    blocks, weights = _topic_blocks(spark, sf)
    moved = TP.reassign_outliers(assign, TP.block_candidates(blocks, weights, assign.filter("topic = -1")))
    counts = cut_lineage(TP.block_counts(blocks, TP.block_classes(blocks, moved)))
    blocks.drop()
    top = terms.top_words(terms.ctfidf(counts), k=10)
    return top.select(F.col("topic").cast("bigint").alias("topic"), "rank", F.col("term").alias("word"),
                      r6("weight").alias("weight"))


@query("topic_similarity")
def q_topic_similarity(spark, sf):
    s = TP.topic_similarity(_topic_weights(spark, sf))
    return s.select(F.col("t1").cast("bigint").alias("t1"), F.col("t2").cast("bigint").alias("t2"),
                    r6("cosine").alias("cosine"))


# -- prompts, payloads and tags ------------------------------------------------

from ..operators import tags as TG  # noqa: E402
from ..sources import files as SF  # noqa: E402
from . import fixtures as FX  # noqa: E402


def _payloads(spark, sf):
    from ..functions.frames import reuse
    raw = FX.payload_texts(spark, sf)
    parsed = reuse(raw.withColumn("payload", SF.parse_payload("raw")))
    ok = F.col("payload").isNotNull() & F.col("payload.texts").isNotNull()
    return parsed.filter(ok).select("topic_id", "payload"), parsed.filter(~ok).select("topic_id", "raw")


@query("payload_parse")
def q_payload_parse(spark, sf):
    ok, bad = _payloads(spark, sf)
    return ok.select("topic_id", F.lit(1).cast("bigint").alias("ok")).unionByName(
        bad.select("topic_id", F.lit(0).cast("bigint").alias("ok"))).select(
        F.col("topic_id").cast("bigint").alias("topic_id"), "ok")


def _classified(spark, sf):
    ok, _ = _payloads(spark, sf)
    return TG.classify_tags(ok)


def _tags_out(df):
    return df.select("dataset_id", "kind", "tag", r6("score").alias("score"))


@query("classify_tags")
def q_classify_tags(spark, sf):
    return _tags_out(_classified(spark, sf))


@query("missing_ids")
def q_missing_ids(spark, sf):
    ok, _ = _payloads(spark, sf)
    found = TG.doc_topics(ok)
    return TG.missing_ids(T.load_catalogue(spark, sf), found)


@query("propagate_tags")
def q_propagate_tags(spark, sf):
    ok, _ = _payloads(spark, sf)
    entries = TG.payload_entries(ok)
    _, similar = _dedupe(spark, sf)
    spread = DD.propagate_tags(entries, similar)
    lists = TG.topic_lists(ok)
    kind = F.coalesce(F.col("nested_kind"), F.col("listed_kind"), F.lit("themes"))
    out = (spread.join(lists, ["topic", "tag"], "left")
                 .groupBy("dataset_id", kind.alias("kind"), "tag").agg(F.max("score").alias("score")))
    return _tags_out(out)


@query("threshold_tags")
def q_threshold_tags(spark, sf):
    return _tags_out(TG.threshold_tags(_classified(spark, sf), {"themes": 0.7, "overarching_themes": 0.5}))


@query("select_labels")
def q_select_labels(spark, sf):
    s = _classified(spark, sf).select(F.col("dataset_id").alias("doc_id"), F.col("tag").alias("label"), "score")
    out = TG.select_labels(s.filter(F.col("score").isNotNull()), 0.5, True)
    return out.select("doc_id", "label", r6("score").alias("score"))


@query("select_label_single")
def q_select_label_single(spark, sf):
    s = _classified(spark, sf).select(F.col("dataset_id").alias("doc_id"), F.col("tag").alias("label"), "score")
    out = TG.select_labels(s.filter(F.col("score").isNotNull()), 0.5, False)
    return out.select("doc_id", "label", r6("score").alias("score"))


def _topic_tag_table(spark, sf):
    top = terms.top_words(_topic_weights(spark, sf), k=10).filter(F.col("topic") != -1)
    return top.select("topic", F.col("term").alias("tag"), F.col("rank").alias("tag_rank"))


@query("candidate_tags")
def q_candidate_tags(spark, sf):
    dt = TP.top_topics(_membership(spark, sf), k=2)
    return TG.candidate_tags(dt, _topic_tag_table(spark, sf))


@query("ordered_distinct_tags")
def q_ordered_distinct(spark, sf):
    dt = TP.top_topics(_membership(spark, sf), k=2).select("doc_id", "topic", F.col("rank").alias("topic_rank"))
    seq = dt.join(_topic_tag_table(spark, sf), "topic").select(
        "doc_id", "tag", (F.col("topic_rank") * 100 + F.col("tag_rank")).alias("pos"))
    od = TG.ordered_distinct(seq)
    return od.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("common_tags")
def q_common_tags(spark, sf):
    """U4 predicted vs actual: candidate tags (from each document's top-2
    topics) that the payload also gives the document."""
    dt = TP.top_topics(_membership(spark, sf), k=2)
    predicted = TG.candidate_tags(dt, _topic_tag_table(spark, sf))
    actual = _classified(spark, sf).select(F.col("dataset_id").alias("doc_id"), "tag")
    return TG.shared_tags(predicted, actual)


@query("tag_shares")
def q_tag_shares(spark, sf):
    s = TG.tag_shares(_classified(spark, sf))
    return s.select("kind", "tag", "n", r6("share").alias("share"))


@query("score_histogram")
def q_score_histogram(spark, sf):
    h = TG.score_histogram(_classified(spark, sf).filter(F.col("score").isNotNull()))
    return h.select("kind", F.col("bin").cast("bigint").alias("bin"), "n")


PROMPT_TEMPLATE = "Texts of one group:\n[DOCUMENTS]\nIts leading words: [KEYWORDS]\nText numbers: [IDS]\n"


def _budgeted_docs(spark, sf, n_docs=10, words=50, budget=300):
    docs, assign = _docs(spark, sf), T.topic_assignments(spark, sf)
    blocks, weights = _topic_blocks(spark, sf)
    top = terms.top_words(weights, k=10)
    rep = cut_lineage(TP.block_representatives(blocks, weights, assign, n=n_docs))
    blocks.drop()
    d = rep.join(docs, "doc_id").select(
        "topic", "rank", "doc_id",
        F.concat(F.lit("ID: "), F.col("doc_id").cast("string"), F.lit("\n\n"),
                 TG.truncate_words("text", words)).alias("doc"))
    d = d.withColumn("tokens", TG.word_count("doc"))
    return TG.fit_budget(d, budget), top


@query("truncate_docs")
def q_truncate_docs(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", TG.truncate_words("text", 50).alias("truncated"),
                    TG.word_count("text").cast("bigint").alias("words"))


@query("fit_budget")
def q_fit_budget(spark, sf):
    d, _ = _budgeted_docs(spark, sf)
    return d.select(F.col("topic").cast("bigint").alias("topic"), "rank", "doc_id",
                    F.col("tokens").cast("bigint").alias("tokens"))


@query("build_prompts")
def q_build_prompts(spark, sf):
    d, top = _budgeted_docs(spark, sf)
    p = TG.build_prompts(top, d, PROMPT_TEMPLATE)
    return p.select(F.col("topic").cast("bigint").alias("topic"), "prompt")


# -- experiment runs -----------------------------------------------------------

from ..operators import runs as RU  # noqa: E402
from ..operators import stats as ST  # noqa: E402

DATASETS = ["F", "O", "P"]


def _runs(spark, sf):
    return T.experiment_runs(spark, sf)


@query("mean_by_model")
def q_mean_by_model(spark, sf):
    m = RU.mean_by_model(_runs(spark, sf))
    return m.select("Model", r6("npmi").alias("npmi"), r6("diversity").alias("diversity"))


@query("leaderboard")
def q_leaderboard(spark, sf):
    b = RU.leaderboard(_runs(spark, sf), DATASETS, digits=None)
    cols = [r6(c).alias(c) for c in b.columns if c not in ("Model", "position")]
    return b.select("Model", F.col("position").cast("bigint").alias("position"), *cols)


@query("topic_quality")
def q_topic_quality(spark, sf):
    q = RU.topic_quality(_runs(spark, sf))
    return q.select("Model", "Dataset", r6("quality").alias("quality"))


def _run_records(spark, sf):
    r = _runs(spark, sf)
    params = (F.when(F.col("Model").isin("1-URGENT", "2-HIGH"),
                     F.create_map(F.lit("num_topics"), F.col("nr_topics").cast("string")))
               .when(F.col("Model") == "5-LOW",
                     F.create_map(F.lit("nr_topics"), F.lit("0"), F.lit("n_components"), F.col("nr_topics").cast("string")))
               .otherwise(F.create_map(F.lit("nr_topics"), F.col("nr_topics").cast("string"))))
    # file index = position of the dataset among the distinct datasets (bounded)
    from pyspark.sql import Window
    ds = r.select("Dataset").distinct().withColumn("file_index", F.row_number().over(Window.orderBy("Dataset")) - 1)
    return r.select("run_id", "Model", "Dataset", params.alias("Params")).join(ds, "Dataset")


@query("flatten_runs")
def q_flatten_runs(spark, sf):
    f = RU.flatten_runs(_run_records(spark, sf))
    return f.select("run_id", "Model", F.col("nr_topics").cast("bigint").alias("nr_topics"))


@query("flatten_slices")
def q_flatten_slices(spark, sf):
    r = _runs(spark, sf).withColumn("slice", F.year("ts").cast("string"))
    per = r.groupBy("Model", "Dataset", "slice").agg(F.avg("npmi").alias("npmi"), F.avg("diversity").alias("diversity"))
    # one map per (model, dataset), bounded by the number of time slices
    dtm = per.groupBy("Model", "Dataset").agg(F.map_from_entries(F.collect_list(
        F.struct("slice", F.struct("npmi", "diversity")))).alias("Scores"))
    f = RU.flatten_slices(dtm)
    return f.select("Model", "Dataset", "slice", r6("npmi").alias("npmi"), r6("diversity").alias("diversity"))


@query("band")
def q_band(spark, sf):
    b = RU.band(_runs(spark, sf))
    return b.select("Model", F.col("nr_topics").cast("bigint").alias("nr_topics"),
                    *[r6(c).alias(c) for c in ("mean", "std", "lower", "upper")])


@query("run_summary")
def q_run_summary(spark, sf):
    s = RU.run_summary(_runs(spark, sf))
    return s.select("Model", F.col("nr_topics").cast("bigint").alias("nr_topics"), "runs",
                    *[r6(c).alias(c) for c in ("mean", "std", "median")])


@query("grid")
def q_grid(spark, sf):
    r = _runs(spark, sf)
    params = r.agg(F.array_sort(F.collect_set("Model")).alias("Model"),
                   F.array_sort(F.collect_set("nr_topics")).alias("nr_topics"))
    g = RU.grid(params)
    return g.select("Model", F.col("nr_topics").cast("bigint").alias("nr_topics"))


@query("best_run")
def q_best_run(spark, sf):
    r = _runs(spark, sf)
    out = None
    for k in (1, 2, 3):
        b = RU.best_run(r, rank=k)
        out = b if out is None else out.unionByName(b)
    return out.select("Model", F.col("nr_topics").cast("bigint").alias("nr_topics"), r6("mean").alias("mean"),
                      F.col("place").cast("bigint").alias("place"))


@query("top3_marks")
def q_top3_marks(spark, sf):
    b = RU.leaderboard(_runs(spark, sf), DATASETS, digits=3)
    cols = [c for c in b.columns if c not in ("Model", "position")]
    t = RU.top3_marks(b, cols)
    return t.select("column", "Model", r6("value").alias("value"), F.col("mark").cast("bigint").alias("mark"))


# -- statistics ---------------------------------------------------------------

def _nt(df):
    return df.withColumn("nr_topics", F.col("nr_topics").cast("bigint"))


@query("levene")
def q_levene(spark, sf):
    t = ST.levene(_runs(spark, sf), "npmi", "Model", ["nr_topics"])
    return _nt(t).select("nr_topics", r6("W").alias("W"))


@query("bartlett")
def q_bartlett(spark, sf):
    t = ST.bartlett(_runs(spark, sf), "npmi", "Model", ["nr_topics"])
    return _nt(t).select("nr_topics", r6("T").alias("T"))


@query("cell_residuals")
def q_cell_residuals(spark, sf):
    t = ST.cell_residuals(_runs(spark, sf), "npmi", ["Model", "nr_topics"], "run_id")
    return t.select("run_id", r6("residual").alias("residual"))


@query("welch_anova")
def q_welch_anova(spark, sf):
    t = ST.welch_anova(_runs(spark, sf), "npmi", "Model")
    return t.select(r6("F_stat").alias("F_stat"), r6("df1").alias("df1"), r6("df2").alias("df2"), r6("np2").alias("np2"))


@query("games_howell")
def q_games_howell(spark, sf):
    t = ST.games_howell(_runs(spark, sf), "npmi", "Model")
    return t.select("A", "B", *[r6(c).alias(c) for c in ("diff", "se", "T", "q", "df", "hedges")])


@query("anova")
def q_anova(spark, sf):
    t = ST.anova(_runs(spark, sf), "npmi", "Model", ["nr_topics"])
    return _nt(t).select("nr_topics", r6("F_stat").alias("F_stat"), r6("np2").alias("np2"))


@query("correlation")
def q_correlation(spark, sf):
    t = ST.correlation(_runs(spark, sf), "npmi", "diversity", ["Model"])
    return t.select("Model", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("kruskal")
def q_kruskal(spark, sf):
    t = ST.kruskal(_runs(spark, sf), "npmi", "Model")
    return t.select(r6("H").alias("H"), r6("df").alias("df"), r6("eta2").alias("eta2"))


@query("dunn")
def q_dunn(spark, sf):
    t = ST.dunn(_runs(spark, sf), "npmi", "Model")
    return t.select("A", "B", r6("z").alias("z"))


@query("cliffs_delta")
def q_cliffs_delta(spark, sf):
    t = ST.cliffs_delta(_runs(spark, sf), "diversity", "Model")
    return t.select("A", "B", r6("delta").alias("delta"))


@query("cohens_d")
def q_cohens_d(spark, sf):
    t = ST.cohens_d(_runs(spark, sf), "npmi", "Model")
    return t.select("A", "B", r6("d").alias("d"))


@query("describe_scores")
def q_describe(spark, sf):
    t = ST.describe(_runs(spark, sf), "npmi", ["Model"])
    return t.select("Model", "n", *[r6(c).alias(c) for c in ("mean", "sd", "skewness", "kurtosis", "mode", "median")])


@query("anderson_darling")
def q_anderson(spark, sf):
    t = ST.anderson_darling(_runs(spark, sf), "npmi", ["Model"])
    return t.select("Model", "n", r6("A2").alias("A2"), r6("A2_star").alias("A2_star"))


@query("test_pvalues")
def q_test_pvalues(spark, sf):
    r = _runs(spark, sf)
    parts = [
        ST.welch_anova(r, "npmi", "Model").select(F.lit("welch_anova").alias("test"), F.lit("").alias("key"), "p"),
        ST.kruskal(r, "npmi", "Model").select(F.lit("kruskal").alias("test"), F.lit("").alias("key"), "p"),
        ST.levene(r, "npmi", "Model", ["nr_topics"]).select(F.lit("levene").alias("test"),
                                                             F.col("nr_topics").cast("string").alias("key"), "p"),
        ST.bartlett(r, "npmi", "Model", ["nr_topics"]).select(F.lit("bartlett").alias("test"),
                                                               F.col("nr_topics").cast("string").alias("key"), "p"),
        ST.dunn(r, "npmi", "Model").select(F.lit("dunn").alias("test"), F.concat_ws("|", "A", "B").alias("key"),
                                           F.col("p_bonf").alias("p")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("test", "key", r6("p").alias("p"))


# -- agreement, time, profiles -------------------------------------------------

from ..operators import agreement as AG  # noqa: E402
from ..operators import overtime as OT  # noqa: E402
from ..operators import profile as PR  # noqa: E402


def _ratings(spark, sf):
    return AG.one_rating(T.ratings(spark, sf))


@query("fleiss_kappa")
def q_fleiss(spark, sf):
    k = AG.fleiss_kappa(_ratings(spark, sf))
    return k.select(r6("p_bar").alias("p_bar"), r6("pe").alias("pe"), r6("kappa").alias("kappa"))


@query("krippendorff_alpha")
def q_kripp(spark, sf):
    r = _ratings(spark, sf)
    out = None
    for lev in ("nominal", "ordinal", "interval"):
        a = AG.krippendorff_alpha(r, lev)
        out = a if out is None else out.unionByName(a)
    return out.select("level", r6("alpha").alias("alpha"))


@query("icc")
def q_icc(spark, sf):
    return AG.icc(_ratings(spark, sf)).select("type", r6("icc").alias("icc"))


@query("confusion")
def q_confusion(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = T.table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id").select((F.col("n_chars") >= 2000).cast("int").alias("pred"),
                                     F.col("quality").alias("truth"))
    c = AG.confusion(j)
    return c.select(*[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")],
                    *[r6(x).alias(x) for x in ("accuracy", "precision", "recall", "specificity", "f1")])


def _intruders(spark, sf):
    dt = TP.top_topics(_membership(spark, sf), k=2)
    tags = _topic_tag_table(spark, sf).filter(F.col("tag_rank") <= 5)
    shown = dt.filter("rank = 1").join(tags, "topic").select("doc_id", "tag")
    foreign = dt.filter("rank = 2").join(tags, "topic").select("doc_id", "tag")
    return dt, shown, AG.intruder_tasks(shown, foreign)


@query("intruder_tasks")
def q_intruder_tasks(spark, sf):
    _, _, t = _intruders(spark, sf)
    return t.select("doc_id", "intruder")


@query("intruder_rate")
def q_intruder_rate(spark, sf):
    dt, shown, tasks = _intruders(spark, sf)
    first = dt.filter("rank = 1").select("doc_id", "topic")
    options = shown.unionByName(tasks.select("doc_id", F.col("intruder").alias("tag")))
    wts = _topic_weights(spark, sf).select("topic", F.col("term").alias("tag"), "weight")
    # simulated judge: the option least typical of the document's own topic
    scored = options.join(first, "doc_id").join(wts, ["topic", "tag"], "left") \
                    .withColumn("weight", F.coalesce(F.col("weight"), F.lit(0.0)))
    answers = scored.groupBy("doc_id").agg(F.min_by(F.col("tag"), F.struct(F.col("weight"), F.col("tag"))).alias("answer"))
    r = AG.intruder_rate(tasks.withColumn("n_tags", F.lit(5)), answers)
    return r.select(F.col("n_tags").cast("bigint").alias("n_tags"), r6("rate").alias("rate"), "tasks")


@query("rating_means")
def q_rating_means(spark, sf):
    m = AG.rating_means(T.ratings(spark, sf))
    return m.select("model", r6("mean").alias("mean"), "rated", "na")


@query("label_agreement")
def q_label_agreement(spark, sf):
    n = TP.nearest(_vectors(spark, sf), _centroids(spark, sf), cls="label").withColumnRenamed("label", "topic")
    a = AG.label_agreement(n, _vectors(spark, sf))
    return a.select(*[r6(c).alias(c) for c in a.columns])


@query("equal_bins")
def q_equal_bins(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "ts")
    b = OT.equal_bins(e, "ts", 10)
    return b.select("event_id", F.col("bin").cast("bigint").alias("bin"), "bin_start")


@query("slice_sizes")
def q_slice_sizes(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "ts")
    s = OT.slice_sizes(e, "ts", 10)
    return s.select(F.col("bin").cast("bigint").alias("bin"), "bin_start", "size")


@query("topics_over_time")
def q_topics_over_time(spark, sf):
    docs = _docs(spark, sf)
    ev = T.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    timed = OT.equal_bins(docs.join(ev, "doc_id"), "ts", 10)
    assign = T.topic_assignments(spark, sf)
    counts = OT.bin_counts(timed.select("doc_id", "bin", "text").join(assign, "doc_id"))
    idf = _topic_weights(spark, sf).select("term", "idf").distinct()
    t = OT.topics_over_time(counts, idf, top=5)
    return t.select(F.col("bin").cast("bigint").alias("bin"), F.col("topic").cast("bigint").alias("topic"),
                    "frequency", "words")


@query("histogram_length")
def q_hist_len(spark, sf):
    h = PR.histogram(T.table(spark, sf, "documents").select("n_chars"), "n_chars", 100)
    return h.select(F.col("bin").cast("bigint").alias("bin"), r6("left").alias("left"), "count")


@query("histogram_words")
def q_hist_words(spark, sf):
    d = T.table(spark, sf, "documents").select(PR.word_count("text").alias("words"))
    h = PR.histogram(d, "words", 100)
    return h.select(F.col("bin").cast("bigint").alias("bin"), r6("left").alias("left"), "count")


@query("availability")
def q_availability(spark, sf):
    return PR.availability(T.load_catalogue(spark, sf))


@query("versions")
def q_versions(spark, sf):
    cat = T.load_catalogue(spark, sf).select("dataset_id", F.col("source").alias("name"))
    pairs, groups = DD.representative_pairs(_docs(spark, sf), PAIRS_T)
    return PR.versions(cat, pairs, groups)


@query("reading_ease")
def q_reading_ease(spark, sf):
    r = PR.reading_ease(_docs(spark, sf))
    return r.select("doc_id", F.col("words").cast("bigint").alias("words"),
                    F.col("sentences").cast("bigint").alias("sentences"),
                    F.col("syllables").cast("bigint").alias("syllables"), r6("ease").alias("ease"))


# -- clustering and topic models ------------------------------------------------

from ..operators import ann as ANN  # noqa: E402
from ..operators import cluster as CU  # noqa: E402
from ..operators import density as DN  # noqa: E402
from ..operators import lda as LDA  # noqa: E402
from ..operators import models as MO  # noqa: E402


@query("knn")
def q_knn(spark, sf):
    k = CU.knn(_vectors(spark, sf), 5)
    return k.select("a", "b", r6("dist").alias("dist"), "rank")


@query("knn_index")
def q_knn_index(spark, sf):
    """J11 by the index: every row is indexed; asked are the rows whose id is divisible by 50."""
    v = _vectors(spark, sf)
    k, _, _ = ANN.knn_index(v, v.filter("doc_id % 50 = 0"), 5)
    return k.select("a", "b", r6("dist").alias("dist"), "rank")


@query("density_clusters")
def q_density_clusters(spark, sf):
    c = CU.density_clusters(_vectors(spark, sf), min_samples=5, min_cluster_size=5)
    return c.select("doc_id", F.col("cluster").cast("bigint").alias("cluster"))


@query("density_hierarchy")
def q_density_hierarchy(spark, sf):
    """M2 "eom": cluster and strength of every vector."""
    t = DN.DensityTree(_vectors(spark, sf), min_samples=5, min_size=5)
    return t.labels.select("doc_id", "cluster", r6("strength").alias("strength"))


@query("density_membership")
def q_density_membership(spark, sf):
    """M5 "probabilities": outliers of the density hierarchy move to their most
    probable cluster if the probability is above 0.01."""
    t = DN.DensityTree(_vectors(spark, sf), min_samples=5, min_size=5)
    probs = t.membership(outliers_only=True).select("doc_id", F.col("cluster").alias("topic"), F.col("prob").alias("score"))
    out = TP.reassign_outliers(t.labels.select("doc_id", F.col("cluster").alias("topic")), probs, threshold=0.01)
    return out.select("doc_id", "topic")


@query("reassign_outliers_probabilities")
def q_reassign_outliers_probabilities(spark, sf):
    """M5 "probabilities" on a given table: vectors at a cosine below 0.25 from
    their nearest topic are outliers; they move to the topic of the largest
    membership if that is above 0.105."""
    cents = _centroids(spark, sf)
    near = TP.nearest(_vectors(spark, sf), cents, cls="label")
    assign = near.select("doc_id", F.when(F.round("cosine", 9) < 0.25, -1).otherwise(F.col("label")).cast("int").alias("topic"))
    probs = _membership(spark, sf).select("doc_id", "topic", F.round("prob", 9).alias("score"))
    out = TP.reassign_outliers(assign, probs, threshold=0.105)
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"))


@query("reduce_dims")
def q_reduce_dims(spark, sf):
    r = CU.reduce_dims(_vectors(spark, sf), 5)
    return r.select("doc_id", F.posexplode("reduced").alias("i", "x")).select(
        "doc_id", F.col("i").cast("bigint").alias("i"), r6(F.abs("x")).alias("abs_x"))


@query("kmeans")
def q_kmeans(spark, sf):
    return CU.kmeans(_vectors(spark, sf), 10).select("doc_id", F.col("cluster").cast("bigint").alias("cluster"))


def _lda(spark, sf, k=10):
    return LDA.lda(terms.document_counts(_docs(spark, sf), "doc_id", "text"), k)


@query("lda")
def q_lda(spark, sf):
    t, _, _ = _lda(spark, sf)
    return t.select(F.col("topic").cast("bigint").alias("topic"), "rank", "term", r6("weight").alias("weight"))


@query("lda_documents")
def q_lda_documents(spark, sf):
    """M6: the topic shares of every document."""
    _, d, _ = _lda(spark, sf)
    return d.select("doc_id", F.col("topic").cast("bigint").alias("topic"), r6("prob").alias("prob"))


@query("nmf")
def q_nmf(spark, sf):
    blocks = BK.WordBlocks(_docs(spark, sf))
    _, H, _ = MO.nmf(DD.block_vectors(blocks).select("doc_id", "term", "weight"), 10, tol=1e-2)
    blocks.drop()
    t = MO.nmf_topics(H)
    return t.select(F.col("topic").cast("bigint").alias("topic"), "rank", "term", r6("weight").alias("weight"))


@query("reduce_topics")
def q_reduce_topics(spark, sf):
    docs = _docs(spark, sf)
    assign = T.topic_assignments(spark, sf)
    mapping, _ = MO.reduce_topics(terms.class_counts(docs, assign), assign, 5)
    return mapping.select(F.col("old").cast("bigint").alias("old"), F.col("new").cast("bigint").alias("new"))


@query("vector_topic_words")
def q_vector_topic_words(spark, sf):
    occ = terms.doc_terms(_docs(spark, sf), "doc_id", "text")
    wv = CU.word_vectors(occ, _vectors(spark, sf))
    t = CU.topic_words_by_vector(wv, _centroids(spark, sf), k=10, cls="label")
    return t.select(F.col("label").cast("bigint").alias("topic"), "rank", "term", r6("cosine").alias("cosine"))


@query("baseline_tags")
def q_baseline_tags(spark, sf):
    t = _topic_tag_table(spark, sf)
    return t.select(F.col("topic").cast("bigint").alias("topic"), "tag",
                    F.col("tag_rank").cast("bigint").alias("tag_rank"))


# -- streaming ----------------------------------------------------------------

from ..session import cut_lineage, scratch_table  # noqa: E402
from ..streaming import jobs as SJ  # noqa: E402


def _run_stream(df_stream, path, mode="append", fmt="parquet"):
    q = (df_stream.writeStream.format(fmt).outputMode(mode)
                  .option("checkpointLocation", path + "/_checkpoint").option("path", path + "/out")
                  .trigger(availableNow=True).start())
    q.awaitTermination()
    return path + "/out"


def _events_stream(spark, sf):
    schema = T.table(spark, sf, "events").schema
    return SJ.file_stream(spark, sf, "events", schema)


@query("stream_counts")
def q_stream_counts(spark, sf):
    from ..functions.time import instant, wall_utc
    s = _events_stream(spark, sf)
    s = s.withColumn("ts", instant(s, "ts"))
    path = scratch_table(spark, "stream_counts")
    counts = SJ.stream_counts(s, "ts", "event_type", "1 day", "1 hour")
    # complete mode: the last batch holds every window, also the open ones
    q = (counts.writeStream.outputMode("complete")
               .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path + "/out"))
               .option("checkpointLocation", path + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.parquet(path + "/out")
    return r.select(wall_utc(spark, F.col("window_start")).alias("window_start"), "event_type", "n")


@query("stream_closed_windows")
def q_stream_closed_windows(spark, sf):
    """T1 in append mode over several arrivals: each lands and is counted by a
    run that goes on from the last one's state; windows leave the state when
    the watermark passes them, events of windows gone are late; a closing row
    ends the last windows."""
    from ..functions.time import wall_utc
    path = scratch_table(spark, "stream_closed")
    T.event_arrivals(spark, sf).write.partitionBy("arrival").parquet(path + "/arrivals")
    arrived = spark.read.parquet(path + "/arrivals")
    events = arrived.drop("arrival")
    days = dict(ts="ts", window="1 day", delay="2 days")
    # one short run an arrival, their number is that of the log's weeks
    arrivals = [r[0] for r in arrived.select("arrival").distinct().orderBy("arrival").collect()]
    for rows in [*[arrived.filter(F.col("arrival") == a).drop("arrival") for a in arrivals],
                 SJ.closing_row(events, **days)]:
        SJ.land(rows, path + "/in")
        SJ.close_windows(spark, path + "/in", events.schema, path + "/out", path + "/_checkpoint", key="event_type", **days)
    r = SJ.late_counts(events, spark.read.parquet(path + "/out"), "ts", "event_type", "1 day")
    return r.select(wall_utc(spark, F.col("window_start")).alias("window_start"), "event_type", "n", "late")


@query("stream_assign")
def q_stream_assign(spark, sf):
    schema = T.table(spark, sf, "embeddings").schema
    s = SJ.file_stream(spark, sf, "embeddings", schema).withColumnRenamed("vec_id", "doc_id")
    path = scratch_table(spark, "stream_assign")
    q = (s.writeStream.foreachBatch(SJ.stream_assign(cut_lineage(_centroids(spark, sf)), path + "/out", cls="label"))
          .option("checkpointLocation", path + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.parquet(path + "/out")
    return r.select("doc_id", F.col("label").cast("bigint").alias("topic"), r6("cosine").alias("cosine"))


@query("stream_dedupe")
def q_stream_dedupe(spark, sf):
    schema = T.table(spark, sf, "documents").schema
    s = SJ.file_stream(spark, sf, "documents", schema)
    from ..functions.time import instant
    evt = T.table(spark, sf, "events")
    ev = evt.select(F.col("event_id").alias("doc_id"), instant(evt, "ts").alias("ts"))
    # stream-static join gives each arriving document its event time
    s = s.join(ev, "doc_id")
    path = scratch_table(spark, "stream_dedupe")
    out = _run_stream(SJ.stream_dedupe(s).select("doc_id", "text_hash"), path)
    return spark.read.parquet(out).groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))


@query("stream_centroids")
def q_stream_centroids(spark, sf):
    schema = T.table(spark, sf, "embeddings").schema
    s = SJ.file_stream(spark, sf, "embeddings", schema)
    path = scratch_table(spark, "stream_centroids")
    q = (s.writeStream.foreachBatch(SJ.stream_centroids(s, path + "/state"))
          .option("checkpointLocation", path + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    c = SJ.read_centroids(spark, path + "/state")
    return c.select(F.col("label").cast("bigint").alias("topic"), F.col("i").cast("bigint").alias("i"),
                    r6("mean").alias("value"))


# -- end to end -------------------------------------------------------------------

from . import tag_pipeline as PL  # noqa: E402


@query("tag_pipeline")
def q_tag_pipeline(spark, sf):
    ok, _ = _payloads(spark, sf)
    out = PL.run(_docs(spark, sf), T.topic_assignments(spark, sf), ok)
    return _tags_out(out["selected"])


# -- remaining inventory items -----------------------------------------------------

@query("document_info")
def q_document_info(spark, sf):
    """Each document with its topic's name and representation."""
    info = TP.topic_info(T.topic_assignments(spark, sf), terms.top_words(_topic_weights(spark, sf), k=10))
    d = T.topic_assignments(spark, sf).join(info.select("topic", "name", "representation"), "topic", "left")
    return d.select("doc_id", F.col("topic").cast("bigint").alias("topic"), "name", "representation")


@query("term_counts_bigrams")
def q_term_counts_bigrams(spark, sf):
    """A1 with n-grams (1, 2) after stop-word removal, per topic."""
    docs = _docs(spark, sf)
    c = terms.class_counts(docs, T.topic_assignments(spark, sf), ngram_max=2)
    return c.select(F.col("topic").cast("bigint").alias("topic"), "term", "n")


@query("vocabulary")
def q_vocabulary(spark, sf):
    """Corpus vocabulary with occurrence and document counts."""
    v = terms.vocabulary(terms.document_counts(_docs(spark, sf), "doc_id", "text"))
    return v.select("term", "n", "docs")


@query("ctfidf_reduce_frequent")
def q_ctfidf_reduce_frequent(spark, sf):
    """A3 with the square-root damping of frequent words."""
    docs = _docs(spark, sf)
    w = terms.ctfidf(terms.class_counts(docs, T.topic_assignments(spark, sf)), reduce_frequent=True)
    top = terms.top_words(w, k=10)
    return top.select(F.col("topic").cast("bigint").alias("topic"), "rank", F.col("term").alias("word"),
                      r6("weight").alias("weight"))


@query("nested_tags")
def q_nested_tags(spark, sf):
    """Per document {"themes": {tag: score}, "overarching_themes": {...}}."""
    return SF.nest_tags(_classified(spark, sf).filter(F.col("score").isNotNull()))


@query("reassign_outliers_embeddings")
def q_reassign_outliers_embeddings(spark, sf):
    """M5 'embeddings' strategy: density-cluster outliers (-1) move to the
    cluster whose centroid is most similar to their vector."""
    v = _vectors(spark, sf)
    clusters = CU.density_clusters(v, min_samples=5, min_cluster_size=5) \
        .withColumnRenamed("cluster", "topic")
    cents = TP.centroids(v.join(clusters.filter("topic != -1"), "doc_id"), cls="topic")
    outliers = v.join(clusters.filter("topic = -1").select("doc_id"), "doc_id", "left_semi")
    cand = TP.nearest(outliers, cents, cls="topic").withColumnRenamed("cosine", "score")
    out = TP.reassign_outliers(clusters, cand, threshold=0.0)
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"))


@query("tukey_hsd")
def q_tukey_hsd(spark, sf):
    t = ST.tukey_hsd(_runs(spark, sf), "npmi", "Model", ["nr_topics"])
    return _nt(t).select("nr_topics", "A", "B", r6("diff").alias("diff"), r6("q").alias("q"), r6("df").alias("df"))


@query("posthoc_pvalues")
def q_posthoc_pvalues(spark, sf):
    r = _runs(spark, sf)
    gh = ST.games_howell(r, "npmi", "Model").select(F.lit("games_howell").alias("test"), "A", "B", "p")
    tk = ST.tukey_hsd(r, "npmi", "Model").select(F.lit("tukey_hsd").alias("test"), "A", "B", "p")
    return gh.unionByName(tk).select("test", "A", "B", r6("p").alias("p"))


@query("gmm_membership")
def q_gmm_membership(spark, sf):
    m = CU.gmm_membership(_vectors(spark, sf), 10)
    return m.select("doc_id", F.col("topic").cast("bigint").alias("topic"), r6("prob").alias("prob"))


# -- source / sink round trips through the shared folder -------------------------

@query("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """S3: documents written as CSV (quoted multi-line fields) and read back."""
    path = scratch_table(spark, "docs_csv")
    SF.write_docs_csv(_docs(spark, sf), path)
    return SF.read_docs_csv(spark, path, "doc_id long, text string")


@query("items_round_trip")
def q_items_round_trip(spark, sf):
    """Scraped items as JSON records (one per page) read with a schema."""
    path = scratch_table(spark, "items_json")
    p = T.table(spark, sf, "pages").select(F.col("page_id").alias("dataset_id"), "url",
                                            CL.html_text("html").alias("scraped_data"))
    p.write.mode("overwrite").json(path)
    return SF.read_items(spark, path, "dataset_id long, url string, scraped_data string", multi_line=False)


@query("run_log_round_trip")
def q_run_log_round_trip(spark, sf):
    """S10 + A24: run records appended as JSON lines, read back, flattened."""
    path = scratch_table(spark, "runs_log")
    recs = _run_records(spark, sf)
    SF.append_records(recs, path)
    back = spark.read.schema(recs.schema).json(path)
    f = RU.flatten_runs(back)
    return f.select("run_id", "Model", F.col("nr_topics").cast("bigint").alias("nr_topics"))


@query("text_by_id_round_trip")
def q_text_by_id_round_trip(spark, sf):
    """The text of every page in a file of its own, the id in its path."""
    path = scratch_table(spark, "text_by_id")
    pages = T.table(spark, sf, "pages").select(F.col("page_id").alias("dataset_id"),
                                               CL.html_text("html").alias("prompt_description"))
    SF.write_text_by_id(pages, path)
    return SF.read_text_partitioned(spark, path)


@query("run_files_round_trip")
def q_run_files_round_trip(spark, sf):
    """S9 + A24: run records in files of one array each, read back with the
    file's index and the record's place, flattened."""
    path = scratch_table(spark, "run_files")
    recs = _run_records(spark, sf).join(_runs(spark, sf).select("run_id", "npmi", "diversity"), "run_id")
    SF.write_runs(recs.select(
        F.format_string("run-%012d.json", F.floor(F.col("run_id") / 500)).alias("file"), F.col("run_id").alias("pos"),
        "Dataset", "Model", "Params", F.to_json(F.struct("npmi", "diversity")).alias("Scores")), path)
    f = RU.flatten_runs(SF.read_runs(spark, path))
    npmi = F.get_json_object("Scores", "$.npmi").cast("double")
    return f.select("file", F.col("file_index").cast("bigint").alias("file_index"), F.col("pos").cast("bigint").alias("pos"),
                    "Dataset", "Model", F.col("nr_topics").cast("bigint").alias("nr_topics"), r6(npmi).alias("npmi"))


@query("timings_round_trip")
def q_timings_round_trip(spark, sf):
    """Timing CSVs of one model each, read back and averaged."""
    path = scratch_table(spark, "timings")
    SF.write_timings(_runs(spark, sf).select("Model", "nr_topics", F.col("npmi").alias("seconds")), path)
    t = SF.read_timings(spark, path).groupBy("Model", F.col("nr_topics").cast("bigint").alias("nr_topics"))
    return t.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("seconds").cast("double"))).alias("seconds"))


@query("corpus_round_trip")
def q_corpus_round_trip(spark, sf):
    """One document per line (line breaks inside become spaces)."""
    path = scratch_table(spark, "corpus_txt")
    SF.save_corpus(_docs(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# -- outliers by token windows, topics as vectors -----------------------------------

from ..operators import distributions as DI  # noqa: E402
from ..operators import vector_topics as VT  # noqa: E402


@query("topic_distributions")
def q_topic_distributions(spark, sf):
    """M5: the topic shares of every document, by windows of four tokens."""
    d = DI.topic_distributions(_docs(spark, sf), _topic_weights(spark, sf))
    return d.select("doc_id", F.col("topic").cast("bigint").alias("topic"), r6("prob").alias("prob"))


@query("reassign_outliers_distributions")
def q_reassign_outliers_distributions(spark, sf):
    """M5 "distributions": outliers move to the topic of their largest share."""
    assign = T.topic_assignments(spark, sf)
    docs = _docs(spark, sf).join(assign.filter("topic = -1").select("doc_id"), "doc_id", "left_semi")
    cand = DI.topic_distributions(docs, _topic_weights(spark, sf)).select("doc_id", "topic", F.round("prob", 9).alias("score"))
    out = TP.reassign_outliers(assign, cand)
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"))


@query("topic_hierarchy")
def q_topic_hierarchy(spark, sf):
    """The merge table of the topics by c-TF-IDF cosine."""
    w = _topic_weights(spark, sf).filter("topic <> -1")
    h = VT.agglomerate(TP.topic_similarity(w), w.select("topic"))
    return h.select("step", "left", "right", r6("distance").alias("distance"), "size")


def _split_topics(spark, sf):
    """Vectors, twice as many topics as labels, and their centroids."""
    v = _vectors(spark, sf).withColumn("topic", (F.col("label") * 2 + F.col("doc_id") % 2).cast("int"))
    sizes = v.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    return v.select("doc_id", "embedding", "topic"), TP.centroids(v).join(sizes, "topic")


@query("merge_close_topics")
def q_merge_close_topics(spark, sf):
    """M8: close topics merge; documents of merged topics are assigned anew;
    topics are numbered by size."""
    v, cents = _split_topics(spark, sf)
    new, names = VT.merge_close(cents, 0.2)
    own = VT.reassign_merged(v, v, new, names)
    ranked = TP.rank_topics(TP.topic_sizes(own)).select("topic", F.col("new_topic").alias("rank"), F.col("count").alias("size"))
    return own.join(ranked, "topic").select("doc_id", "topic", F.col("rank").cast("bigint").alias("rank"), "size")


@query("reduce_by_vectors")
def q_reduce_by_vectors(spark, sf):
    """M8: topics reduced to five by their vectors."""
    v, cents = _split_topics(spark, sf)
    own, _ = VT.reduce_by_vectors(v, v, cents, 5)
    return own.select("doc_id", "topic")


# -- hooks -------------------------------------------------------------------------

from ..operators import hooks as HK  # noqa: E402


def _hooked(spark, sf):
    return HK.evaluate(
        _docs(spark, sf), lambda docs: T.topic_assignments(spark, sf),
        [HK.spread_words(0.05), HK.own_words(3), HK.first_words(10)],
        {"diversity": HK.diversity, "npmi": HK.coherence, "coverage": HK.coverage}, k=40)


@query("hooked_words")
def q_hooked_words(spark, sf):
    """2.12: a model, a UDTF tokenizer and a chain of three representations."""
    words, _ = _hooked(spark, sf)
    return words.select(F.col("topic").cast("bigint").alias("topic"), F.col("rank").cast("bigint").alias("rank"), "term",
                        r6("weight").alias("weight"))


@query("hooked_scores")
def q_hooked_scores(spark, sf):
    """2.12: three metrics of the hooked topics."""
    _, scores = _hooked(spark, sf)
    return scores.select("metric", r6("value").alias("value"))
