"""Corpus profiles: histograms, availability, versions, reading ease
(A16-A19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), every
    bin listed -> (bin 0..bins-1, left, count)."""
    r = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    if r["mn"] is None:  # no value: every bin is empty
        r = {"mn": 0.0, "mx": 0.0}
    mn, mx = float(r["mn"]), float(r["mx"])
    w = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col(col).cast("double") - F.lit(mn)) / F.lit(w))).cast("int")
    counts = df.filter(F.col(col).isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    allb = df.sparkSession.range(0, bins).select(F.col("id").cast("int").alias("bin"))
    return allb.join(counts, "bin", "left").select(
        "bin", (F.lit(mn) + F.col("bin").cast("double") * F.lit(w)).alias("left"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def word_count(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(t, F.lit(r"[\p{L}\p{N}_]+"))


def availability(catalogue: DataFrame, text: str = "description") -> DataFrame:
    """(measure, value, count): number of tags, number of features and
    URL availability ('http' in the text) per dataset."""
    c = catalogue.select(F.size("tag").alias("n_tags"), F.size("features").alias("n_features"),
                         F.col(text).contains("http").cast("int").alias("has_url"))
    parts = [c.groupBy(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value"))
              .agg(F.count(F.lit(1)).alias("count")) for m in ("n_tags", "n_features", "has_url")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def versions(catalogue: DataFrame, pairs: DataFrame, groups: DataFrame, name: str = "name",
             key: str = "dataset_id", member: str = "doc_id") -> DataFrame:
    """Versions per name, and how many similar pairs fall within one name.

    ``groups`` = (member, rep) and ``pairs`` between representatives; pairs are
    counted from the group sizes per name, never expanded: n (n - 1) / 2 within
    a group and the product of the sizes of two linked groups."""
    v = catalogue.groupBy(name).agg(F.count(F.lit(1)).alias("versions"))
    size = (groups.withColumnRenamed(member, key).join(catalogue.select(key, name), key)
                  .groupBy(name, "rep").agg(F.count(F.lit(1)).alias("n")))
    within = size.select(name, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("c"))
    sa = size.select(F.col("rep").alias("a"), name, F.col("n").alias("na"))
    sb = size.select(F.col("rep").alias("b"), name, F.col("n").alias("nb"))
    across = pairs.select("a", "b").join(sa, "a").join(sb, ["b", name]).select(name, (F.col("na") * F.col("nb")).alias("c"))
    both = within.unionByName(across).groupBy(name).agg(F.sum("c").alias("similar_pairs"))
    return v.join(both, name, "left").fillna(0, ["similar_pairs"])


# Fixed value: vowels counted as syllable nuclei (lower-case, with accents).
VOWELS = "aeiouyàâäéèêëîïôöùûüÿæœáíóúñ"


def reading_ease(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Flesch reading ease 206.835 - 1.015 words/sentences - 84.6
    syllables/words; syllables = vowel groups (at least one per word)."""
    t = F.lower(F.col(text))
    words = word_count(text)
    sentences = F.greatest(F.lit(1), F.regexp_count(F.col(text), F.lit(r"[.!?]+")))
    syll = F.greatest(words, F.regexp_count(t, F.lit(f"[{VOWELS}]+")))
    d = df.select(key, words.alias("words"), sentences.alias("sentences"), syll.alias("syllables"))
    return d.withColumn("ease", F.when(F.col("words") > 0,
                                       F.lit(206.835) - 1.015 * F.col("words") / F.col("sentences")
                                       - 84.6 * F.col("syllables") / F.col("words")))
