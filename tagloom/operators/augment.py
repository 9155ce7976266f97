"""Description builders.

Each step is a ``DataFrame -> DataFrame`` function usable with
``DataFrame.transform``; ``augment`` folds a list of them. A step writes
``out`` from the current ``out`` column if it exists, else from the
description column (create-or-update, as in the reference).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import pick

Step = Callable[[DataFrame], DataFrame]


def augment(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Apply steps left to right; input must be a DataFrame."""
    if not isinstance(df, DataFrame):
        raise TypeError("augment expects a DataFrame")
    return reduce(lambda d, f: d.transform(f), steps, df)


def with_name(description: str = "description", name: str = "name",
              out: str = "augmented_description") -> Step:
    """P2: 'Name: ' + name + blank line + text (null name -> null)."""
    def step(df: DataFrame) -> DataFrame:
        base = pick(df, out, description)
        return df.withColumn(out, F.concat(F.lit("Name: "), F.col(name), F.lit("\n\n"), base))
    return step


def with_tags(description: str = "description", tag: str = "tag",
              out: str = "augmented_description", id_col: str = "dataset_id",
              removals: DataFrame | None = None) -> Step:
    """P3: 'Tags: ' + kept tags joined by ', ' + blank line + text.

    ``removals`` is a (id_col, tag) table; listed tags are dropped from that
    row's list, keeping order and repeats of the others. Null list -> ''.
    """
    def step(df: DataFrame) -> DataFrame:
        base = pick(df, out, description)
        d = df.withColumn("__base", base)
        tags = F.col(tag)
        if removals is not None:
            rm = (removals.select(F.col(id_col), F.col(removals.columns[1]).alias("__rm_tag"))
                          .groupBy(id_col).agg(F.collect_set("__rm_tag").alias("__rm")))
            d = d.join(rm, id_col, "left")
            tags = F.filter(tags, lambda t: ~F.coalesce(F.array_contains(F.col("__rm"), t), F.lit(False)))
        joined = F.coalesce(F.array_join(tags, ", "), F.lit(""))
        d = d.withColumn(out, F.concat(F.lit("Tags: "), joined, F.lit("\n\n"), F.col("__base")))
        drop = ["__base"] + (["__rm"] if removals is not None else [])
        return d.drop(*drop)
    return step


def with_features(description: str = "description", features: str = "features",
                  out: str = "augmented_description", max_features: int = 10000,
                  reduce_features: bool = False) -> Step:
    """Text + blank line + 'Features: ' + names joined by ', '.

    With more than ``max_features`` names, the first ``max_features`` are kept
    and 'and K more...' is appended, K counted on the untruncated list. With
    ``reduce_features`` the features column itself is cut to the limit.
    Null feature list -> ''.
    """
    def step(df: DataFrame) -> DataFrame:
        base = pick(df, out, description)
        names = F.transform(F.col(features), lambda f: f["name"].cast("string"))
        n = F.size(F.col(features))
        listed = F.when(
            n > max_features,
            F.concat(F.slice(names, 1, max_features),
                     F.array(F.concat(F.lit("and "), (n - max_features).cast("string"), F.lit(" more...")))),
        ).otherwise(names)
        text = F.coalesce(F.array_join(listed, ", "), F.lit(""))
        d = df.withColumn(out, F.concat(base, F.lit("\n\nFeatures: "), text))
        if reduce_features:
            d = d.withColumn(features, F.slice(F.col(features), 1, max_features))
        return d
    return step


def with_id(description: str = "description", id_col: str = "dataset_id",
            out: str = "augmented_description") -> Step:
    """P5: 'ID: ' + id + blank line + text."""
    def step(df: DataFrame) -> DataFrame:
        base = pick(df, out, description)
        return df.withColumn(out, F.concat(F.lit("ID: "), F.col(id_col).cast("string"), F.lit("\n\n"), base))
    return step


def latest_scraped(sources: list[DataFrame], id_col: str = "dataset_id",
                   text: str = "scraped_data", order: str | None = None) -> DataFrame:
    """Union scraped sources; later source wins, then later row (``order``).

    Returns (id_col, scraped_data), one row per id. The choice is a
    max_by over (source rank, order), aggregated partially on the map side,
    so a hot id costs one row per task.
    """
    parts = []
    for i, s in enumerate(sources):
        o = F.col(order) if order else F.lit(0)
        parts.append(s.select(F.col(id_col), F.col(text).alias("scraped_data"),
                              F.struct(F.lit(i).alias("src"), o.alias("ord")).alias("__prio")))
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy(id_col).agg(F.max_by("scraped_data", "__prio").alias("scraped_data"))


def with_scraped(scraped: DataFrame, description: str = "description",
                 scraped_col: str = "scraped_data", out: str = "augmented_description",
                 id_col: str = "dataset_id") -> Step:
    """Attach scraped text ('' when none) and append
    '\\n\\nScraped Data: ' + s to the text when s is not empty. Rows without
    scraped text keep their text (the reference's null is not reproduced)."""
    def step(df: DataFrame) -> DataFrame:
        base = pick(df, out, description)
        s = scraped.select(F.col(id_col), F.col("scraped_data").alias("__s"))
        d = df.withColumn("__base", base).join(s, id_col, "left")
        d = d.withColumn(scraped_col, F.coalesce(F.col("__s"), F.lit("")))
        d = d.withColumn(out, F.when(F.col(scraped_col) != "",
                                     F.concat(F.col("__base"), F.lit("\n\nScraped Data: "), F.col(scraped_col)))
                         .otherwise(F.col("__base")))
        return d.drop("__s", "__base")
    return step


def with_rewrites(rewrites: DataFrame, id_col: str = "dataset_id",
                  text: str = "prompt_description") -> Step:
    """Attach rewritten text; rows without a rewrite are removed."""
    def step(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != text]
        return df.select(*cols).join(rewrites.select(id_col, text), id_col, "inner")
    return step


REWRITE_INSTRUCTION = ("\n\nRewrite the description above as one clear paragraph that states what "
                       "the data is about, how it was collected and what it can be used for.")


def rewrite_prompts(df: DataFrame, text: str = "description", out: str = "rewrite_prompt",
                    instruction: str = REWRITE_INSTRUCTION) -> DataFrame:
    """Per-document rewrite request: text followed by an instruction."""
    return df.withColumn(out, F.concat(F.col(text), F.lit(instruction)))


def repair_urls(df: DataFrame, mapping: DataFrame, url: str = "url") -> DataFrame:
    """Exact-match URL rewrites from a (from_url, to_url) table.

    An equi left join; AQE broadcasts the mapping when its measured size is
    small and falls back to a shuffle join when it is not.
    """
    m = mapping.select(F.col("from_url").alias("__from"), F.col("to_url").alias("__to")).dropDuplicates(["__from"])
    return (df.join(m, F.col(url) == F.col("__from"), "left")
              .withColumn(url, F.coalesce(F.col("__to"), F.col(url)))
              .drop("__from", "__to"))


def topic_labels(top: DataFrame, cls: str = "topic", k: int = 3, term: str = "term",
                 rank: str = "rank") -> DataFrame:
    """P15: '<topic>_w1_w2_w3' from ranked top words (rank 1..k)."""
    w = top.filter(F.col(rank) <= k)
    g = w.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(term)))).alias("__ws"))
    return g.select(cls, F.concat_ws("_", F.col(cls).cast("string"),
                                     F.array_join(F.transform("__ws", lambda s: s[term]), "_")).alias("label"))
