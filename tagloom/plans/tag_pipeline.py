"""The tag pipeline as one composition of library operators.

catalogue -> description builders -> near-duplicate removal -> topic
assignment (input) -> c-TF-IDF -> representative documents -> prompts (out)
-> topic payloads (in) -> tag classification -> propagation to removed
duplicates -> score thresholds. Every step is a DataFrame; the only driver
round trips are the bounded scalars inside the iterative dedupe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as AU
from ..operators import dedupe as DD
from ..operators import tags as TG
from ..operators import terms
from ..operators import topics as TP


@dataclass
class PipelineConfig:
    dedupe_threshold: float = 0.99
    top_words: int = 10
    rep_docs: int = 4
    doc_words: int = 50
    prompt_budget: int = 300
    prompt_template: str = "Texts of one group:\n[DOCUMENTS]\nIts leading words: [KEYWORDS]\n"
    minimum: dict = field(default_factory=lambda: {"themes": 0.7, "overarching_themes": 0.5})


def run(docs: DataFrame, assign: DataFrame, payloads: DataFrame, cfg: PipelineConfig | None = None,
        catalogue: DataFrame | None = None, removals: DataFrame | None = None,
        scraped: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs = (doc_id, text); assign = (doc_id, topic); payloads = parsed
    (topic_id, payload). Returns the stage outputs by name."""
    cfg = cfg or PipelineConfig()
    out: dict[str, DataFrame] = {}
    if catalogue is not None:
        steps = [AU.with_id(), AU.with_name(), AU.with_tags(removals=removals), AU.with_features(max_features=100)]
        if scraped is not None:
            steps.append(AU.with_scraped(scraped))
        out["augmented"] = AU.augment(catalogue, steps)
    kept, similar = DD.drop_similar(docs, cfg.dedupe_threshold)
    out["kept"], out["similar"] = kept, similar
    # everything after the removal works on the kept documents
    docs_all, docs = docs, kept
    assign = assign.join(kept.select("doc_id"), "doc_id", "left_semi")
    weights = terms.ctfidf(terms.class_counts(docs, assign))
    top = terms.top_words(weights, k=cfg.top_words)
    out["topic_words"] = top
    doc_counts = terms.document_counts(docs, "doc_id", "text")
    rep = TP.representative_docs(TP.doc_class_vectors(doc_counts, weights), weights, assign, n=cfg.rep_docs)
    rep_docs = rep.join(docs, "doc_id").select(
        "topic", "rank", "doc_id",
        F.concat(F.lit("ID: "), F.col("doc_id").cast("string"), F.lit("\n\n"),
                 TG.truncate_words("text", cfg.doc_words)).alias("doc"))
    rep_docs = TG.fit_budget(rep_docs.withColumn("tokens", TG.word_count("doc")), cfg.prompt_budget)
    out["prompts"] = TG.build_prompts(top, rep_docs, cfg.prompt_template)
    entries = TG.payload_entries(payloads)
    spread = DD.propagate_tags(entries, similar)
    lists = TG.topic_lists(payloads)
    kind = F.coalesce(F.col("nested_kind"), F.col("listed_kind"), F.lit("themes"))
    tags = (spread.join(lists, ["topic", "tag"], "left")
                  .groupBy("dataset_id", kind.alias("kind"), "tag").agg(F.max("score").alias("score")))
    out["tags"] = tags
    out["selected"] = TG.threshold_tags(tags, cfg.minimum)
    out["missing"] = TG.missing_ids(docs_all.select(F.col("doc_id").alias("dataset_id")),
                                    tags.select("dataset_id"))
    return out
