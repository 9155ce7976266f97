"""Column expressions for text: tokenising, cleaning, stop words.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
# Word token: two or more letters, digits or underscores (the Unicode form of
# "\b\w\w+\b"). Written with property classes so the JVM and RE2 agree.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# A maximal run of word characters (used to emulate word boundaries).
WORD_RUN_PATTERN = r"[\p{L}\p{N}_]+"
# Vocabulary-limit token: a whole word of two or more ASCII letters.
ALPHA_WORD = r"^[a-z]{2,}$"

# Spark's default English stop-word list (StopWordsRemover, "english"),
# in its own order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've "
    "isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's "
    "when's where's who's why's would"
).split()
# ---------------------------------------------------------------------------


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """Array of word tokens of a text column, in order."""
    t = col_of(text)
    if lowercase:
        t = F.lower(t)
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), 0)


def alpha_tokens(text) -> Column:
    """Lower-cased whole words made only of ASCII letters (two or more):
    word runs are cut first, so a letter run inside a longer word with
    accents or digits is not a token (word-boundary semantics)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(col_of(text), F.lit(""))), F.lit(WORD_RUN_PATTERN), 0)
    return F.filter(runs, lambda t: t.rlike(ALPHA_WORD))


def drop_words(arr, words) -> Column:
    """Remove the given words from a token array, keeping order and repeats.

    ``isin`` with many literals becomes a hash-set lookup (InSet) in the
    optimizer, so this is O(1) per token and never leaves the JVM.
    """
    words = list(words or [])
    a = col_of(arr)
    if not words:
        return a
    return F.filter(a, lambda t: ~t.isin(words))


def ngrams(arr, n_max: int = 1) -> Column:
    """Unigrams, or unigrams followed by bigrams of adjacent tokens."""
    a = col_of(arr)
    if n_max <= 1:
        return a
    if n_max != 2:
        raise ValueError("only (1,1) and (1,2) n-gram ranges are supported")
    bigrams = F.when(
        F.size(a) >= 2,
        F.transform(F.sequence(F.lit(1), F.size(a) - 1),
                    lambda i: F.concat_ws(" ", F.element_at(a, i), F.element_at(a, i + 1))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(a, bigrams)


def clean_newlines_lower(text) -> Column:
    """Newline -> space, then lower-case."""
    return F.lower(F.replace(col_of(text), F.lit("\n"), F.lit(" ")))


# Fixed value: the white-space class of Python's str.isspace()/re "\s".
WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"


def squash_whitespace(text) -> Column:
    """Collapse every run of white space to one space."""
    return F.regexp_replace(col_of(text), WHITESPACE + "+", " ")


def sql_string_list(words) -> str:
    """Words as a SQL literal list (for oracle SQL and SQL expressions)."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
