"""Operator 11, mixing sources to target weights by Pareto order sampling.

DataFrame functions only. Sources in code point order (null last) weigh
``WEIGHTS``, repeating, and share ``SHARE`` of all words; a target stops at
``MOST`` times its source's words and the excess goes to the others by weight.

A source with target t and s words takes floor(t / s) whole copies of every
document for certain. What is then missing, its rest, is drawn: a document of
n words is included once more with probability min(1, c * n ** ``POWER``), c
being solved so that the expected words are the rest. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)), random odds by inclusion odds, and taken in that
order until the words are nearest to the rest: a sample of fixed size (in
words) with unequal probabilities. u is a hash of the doc_id, so reruns agree.

How it is spread: texts are read once and only (doc_id, source, size) goes on.
Word counts are summed by (source, size) first, so targets and c come from a
small table. Odds become buckets of about ``BUCKET`` rows; the words of each
(source, bucket) tell in which bucket a source's sample ends, and only the rows
of that one are ordered. Nothing of a source's size is ever in one task.

Defined results: a null or empty text has size 0 and takes nothing; a source
without words has target 0; rows equal in doc_id, source and size share a draw,
and of those that stand at the end of a sample as many are taken as fit;
repeated rows each get a row; an empty table gives an empty result; further
columns are ignored by ``mix`` and kept by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
POWER = 0.5
SEED = 11
BUCKET = 1 << 12
RANKED = 1 << 18

SOURCE = ["none", "src"]


def n_words(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")).cast("long")


def _uniform(doc_id: str, seed: int) -> Column:
    """A number inside (0, 1) from the first 52 bits of a hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").isNull().alias("none"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_words("text").alias("size"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0), in ranges of about ``RANKED``."""
    n = -(-max(1, sources.count()) // RANKED)
    parts = staged(sources.repartitionByRange(n, *SOURCE).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").count().select("part", before.alias("start"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE)) - 1
    return parts.withColumn("here", here).join(starts, "part") \
        .withColumn("place", F.col("start") + F.col("here")).drop("part", "here", "start")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (none, src, source_size) with ``target``: the weight times
    one level for all, at most ``most`` times the source's size. The level is
    found by aggregates, which only send sums here."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    known = staged(_ranked(sources).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-caps")
    level, full = 0.0, -1
    total = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        capped = (F.col("cap") <= F.col("weight") * F.lit(level)) if full >= 0 else F.lit(False)
        got = known.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap")).otherwise(0)).alias("caps"),
                        F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if got["n"] == full or not got["weights"]:
            break
        full, level = got["n"], (total - got["caps"]) / got["weights"]
    return known.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))) \
        .select(*SOURCE, "source_size", "target")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, power: float = POWER) -> DataFrame:
    """One row per source of ``rows`` (none, src, size): source_size, target,
    whole (certain copies), rest (words still to draw) and scale (the c of the
    inclusion probabilities)."""
    profile = staged(rows.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), "mix-profile")
    sources = profile.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    share_of = F.col("target") / F.col("source_size")
    known = targets(sources, weights, share, most) \
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(share_of)).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy(*SOURCE).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    merit = F.pow(F.col("size"), F.lit(power))
    # documents above a size are certain if those up to it can share what they leave
    scale = profile.filter("size > 0").join(known.filter("rest > 0"), SOURCE) \
        .withColumn("low", F.sum(F.col("n") * F.col("size")).over(upto)) \
        .withColumn("merits", F.sum(F.col("n") * F.col("size") * merit).over(upto)) \
        .withColumn("scale", (F.col("rest") - (F.col("source_size") - F.col("low"))) / F.col("merits")) \
        .filter(F.col("scale") * merit <= 1).groupBy(*SOURCE).agg(F.max_by("scale", "size").alias("scale"))
    return known.join(scale, SOURCE, "left")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, power: float = POWER,
        seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, none and src (its source), size,
    source_size, target, copies and taken (words)."""
    rows = staged(_keyed(docs).withColumn("u", _uniform("doc_id", seed)), "mix-rows")
    sources = staged(plan(rows, weights, share, most, power), "mix-plan")
    p = F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("size"), F.lit(power)))
    odds = F.col("u") / (1 - F.col("u")) * ((1 - p) / p)
    order = F.when((F.col("size") == 0) | F.col("scale").isNull(), F.lit(None)).when(p >= 1, F.lit(-1.0)).otherwise(odds / (1 + odds))
    n = max(64, rows.count() // bucket)
    keyed = staged(rows.join(sources, SOURCE).withColumn("order", order)
                   .withColumn("bucket", F.when(F.col("order") < 0, -1).otherwise(F.floor(F.col("order") * n)))
                   .drop("u", "scale"), "mix-keyed")

    words = keyed.filter("bucket is not null").groupBy(*SOURCE, "rest", "bucket").agg(F.sum("size").alias("words"))
    sofar = Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = staged(words.withColumn("before", F.coalesce(F.sum("words").over(sofar), F.lit(0)))
                  .filter("before < rest and before + words >= rest")
                  .select(*SOURCE, F.col("bucket").alias("last"), "before"), "mix-last")

    held = keyed.join(last, SOURCE, "left")
    # the rows of the bucket in which the sample ends, equal ones as one
    own = ["doc_id", *SOURCE, "size", "source_size", "target", "whole"]
    ending = held.filter(F.col("bucket") == F.col("last")) \
        .groupBy(*own, "rest", "before", "order").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*SOURCE).orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(ahead), F.lit(0))
    fits = F.least(F.greatest(F.floor(room / F.col("size") + 0.5), F.lit(0)), F.col("n"))
    tail = ending.withColumn("fits", fits).select(*own, "fits", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")) \
        .withColumn("more", (F.col("i") <= F.col("fits")).cast("int")).drop("i", "fits")
    body = held.filter("bucket is null or last is null or bucket <> last") \
        .select(*own, F.when(F.col("bucket") < F.col("last"), 1).otherwise(0).alias("more"))
    copies = (F.col("whole") + F.col("more")).cast("long")
    return body.unionByName(tail).select("doc_id", *SOURCE, "size", "source_size", "target", copies.alias("copies"),
                                         (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, as often
    as ``mixed`` takes them. Of rows equal in doc_id, source and size that are
    not all taken alike, the first by text get the further copy."""
    own = ["doc_id", *SOURCE, "size"]
    totals = mixed.groupBy(*own).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0") \
        .select(F.struct(*[F.coalesce(c, F.lit(0)) if c == "doc_id" else F.col(c) for c in own],
                         F.col("doc_id").isNull().alias("no_id")).alias("k"), "copies", "n")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("source").isNull().alias("none"),
                   F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_words("text").alias("size"),
                   F.col("doc_id").isNull().alias("no_id")).alias("k")
    found = docs.select(row, key).join(totals, "k")
    each = found.filter("copies >= n").select("row", F.explode(F.sequence(F.lit(1), F.floor(F.col("copies") / F.col("n")))))
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("row.text")))
    more = found.filter("copies % n > 0").withColumn("i", first).filter("i <= copies % n")
    return each.select("row").unionByName(more.select("row")).select("row.*")
