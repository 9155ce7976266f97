"""Text cleaning, splitting, HTML extraction and row filters
(P7-P10, P14, F1-F5, F8-F11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import reuse
from ..functions.text import clean_newlines_lower, squash_whitespace  # noqa: F401 (re-export)

# -- P9 paragraphs -------------------------------------------------------------
# The ordered replacements of the paragraph splitter and its
# break marker.
PARAGRAPH_MARK = " \\p "
PARAGRAPH_REPLACEMENTS = (("Mr.\n", "Mr. "), (".\n", PARAGRAPH_MARK),
                          (". \n ", PARAGRAPH_MARK), (". \n", PARAGRAPH_MARK), ("\n", " "))


def paragraphs(df: DataFrame, text: str = "text", year: str | None = None,
               min_year: int | None = None, out: str = "paragraph") -> DataFrame:
    """One row per paragraph (pos from 0), empty paragraphs kept.

    Ordered literal replacements, split on the break marker, strip, lower.
    Optional filter year > min_year (pushed below the explode).
    """
    if year is not None and min_year is not None:
        df = df.filter(F.col(year) > min_year)
    t = F.col(text)
    for a, b in PARAGRAPH_REPLACEMENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    parts = F.split(t, r"\\p")
    cleaned = F.transform(parts, lambda p: F.lower(strip(p)))
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(cleaned).alias("pos", out))


from ..functions.text import WHITESPACE  # noqa: E402


def strip(c: Column) -> Column:
    """Remove leading and trailing white space (Python str.strip() class)."""
    return F.regexp_replace(c, r"\A%s+|%s+\z" % (WHITESPACE, WHITESPACE), "")


# -- P10 chunks ----------------------------------------------------------------

def chunks(text, size: int) -> Column:
    """P10: split a text into pieces of at most ``size`` characters.

    While more than ``size`` characters remain, a piece ends at the last
    ' ', '.', '!' or '?' within reach (the break character starts the next
    piece); with no break in reach the piece is cut hard at ``size``. The
    rest is the last piece. Pieces are stripped. One regex scan over the
    whole text on the JVM (``\\G`` chains the matches).
    """
    if size < 1:
        raise ValueError("size must be positive")
    pattern = (r"(?s)\G(?:.{1,%d}\z|.{1,%d}(?=[ .!?])|.{%d})" % (size, size, size))
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), strip)


# -- P14 HTML -> text ----------------------------------------------------------

def html_text(html) -> Column:
    """Visible text of a page: scripts, styles, comments and tags
    removed, common entities decoded, white space squashed, stripped."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    h = F.regexp_replace(h, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        h = F.replace(h, F.lit(ent), F.lit(ch))
    return strip(F.regexp_replace(h, WHITESPACE + "+", " "))


def html_sections(html, labels: Iterable[str]) -> Column:
    """P14 (labelled blocks): for each label, the text of the block that
    follows a heading containing it, up to the next heading; parts joined
    with a blank line, empty parts dropped."""
    h = F.col(html) if isinstance(html, str) else html
    parts = []
    for lab in labels:
        pat = r"(?is)<h[1-6][^>]*>[^<]*" + _re_escape(lab) + r"[^<]*</h[1-6]>(.*?)(?=<h[1-6]|</body|$)"
        parts.append(html_text(F.regexp_extract(h, pat, 1)))
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n")


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


# -- filters -------------------------------------------------------------------

def drop_short(df: DataFrame, text: str = "text", min_len: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) — dropped rows have null text or length <= min_len.
    Both are plain filters over the same scan; newlines become spaces in kept."""
    bad = F.col(text).isNull() | (F.length(F.col(text)) <= min_len)
    kept = df.filter(~bad).withColumn(text, F.replace(F.col(text), F.lit("\n"), F.lit(" ")))
    return kept, df.filter(bad)


def drop_flagged(df: DataFrame, flag: str, flag_value, text: str = "text",
                 min_len: int = 2) -> DataFrame:
    """drop flagged rows (e.g. retweets) and empty or too short texts."""
    return df.filter((F.col(flag) != F.lit(flag_value)) & (F.col(text) != "")
                     & (F.length(F.col(text)) > min_len))


def min_length(df: DataFrame, text: str = "description", n: int = 100) -> DataFrame:
    """keep non-empty texts of at least n characters."""
    return df.filter((F.col(text) != "") & (F.length(F.col(text)) >= n))


def keep_domains(df: DataFrame, url: str = "url", domains: Iterable[str] | None = None) -> DataFrame:
    """rows with a URL; optionally only URLs containing an allowed domain."""
    d = df.filter(F.col(url).isNotNull())
    if domains:
        cond = None
        for dom in domains:
            c = F.col(url).contains(dom)
            cond = c if cond is None else (cond | c)
        d = d.filter(cond)
    return d


def align(left: DataFrame, keys: DataFrame, on: str | list[str], keep: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is (keep) / is not (drop) in ``keys``."""
    return left.join(keys, on, "left_semi" if keep else "left_anti")


def remove_stopwords(tokens: DataFrame, words: DataFrame, term: str = "term") -> DataFrame:
    """F10 on a long token table: anti join with a stop-word table."""
    return tokens.join(words.select(F.col(words.columns[0]).alias(term)), term, "left_anti")


def limit_vocabulary(tokens: DataFrame, max_features: int = 2000, term: str = "term") -> DataFrame:
    """F8: keep tokens among the ``max_features`` most frequent (ties by term).

    The ranking is a top-k (TakeOrderedAndProject): each task keeps at most
    ``max_features`` rows, so the final merge is bounded by the parameter.
    """
    freq = tokens.groupBy(term).agg(F.count(F.lit(1)).alias("__n"))
    top = freq.orderBy(F.col("__n").desc(), F.col(term).asc()).limit(max_features)
    return tokens.join(top.select(term), term, "left_semi")


def min_count(tokens: DataFrame, n: int = 50, term: str = "term") -> DataFrame:
    """keep tokens whose corpus count is greater than n."""
    keep = tokens.groupBy(term).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > n)
    return tokens.join(keep.select(term), term, "left_semi")


def fill_oov(topic_words: DataFrame, vocabulary: DataFrame, first_word: str,
             term: str = "term") -> DataFrame:
    """topic words missing from the vocabulary become ``first_word``."""
    # the topic words go to the corpus: only words met there are shuffled
    topic_words = reuse(topic_words)
    asked = topic_words.select(F.col(term).alias("__v")).distinct()
    v = vocabulary.select(F.col(term).alias("__v")).join(F.broadcast(asked), "__v", "left_semi").distinct()
    return (topic_words.join(v, F.col(term) == F.col("__v"), "left")
                       .withColumn(term, F.when(F.col("__v").isNull(), F.lit(first_word)).otherwise(F.col(term)))
                       .drop("__v"))


def first_token(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", term: str = "term") -> DataFrame:
    """The corpus's first word (lowest key, then position), one row."""
    return tokens.agg(F.min_by(F.col(term), F.struct(F.col(key), F.col(pos))).alias(term))


def exact_dedupe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: one row per distinct value of ``cols``."""
    return df.dropDuplicates(cols)
