"""Spark queries against their DuckDB oracle on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tagloom.sources.tables import TABLES

FAST = ["ctfidf_top_words", "catalogue_load", "augment_all", "attach_rewrites", "paragraphs", "html_text",
        "drop_short", "limit_vocabulary", "fill_oov", "tfidf_weights", "similar_pairs", "drop_similar_kept",
        "drop_similar_pairs", "npmi_window", "npmi_document", "diversity", "silhouette", "nearest_topic",
        "membership", "representative_docs", "reassign_outliers", "classify_tags", "propagate_tags",
        "select_labels", "build_prompts", "fit_budget", "leaderboard", "run_summary", "levene", "welch_anova",
        "games_howell", "kruskal", "dunn", "cliffs_delta", "describe_scores", "fleiss_kappa",
        "krippendorff_alpha", "icc", "slice_sizes", "topics_over_time", "histogram_words", "knn",
        "stream_counts", "stream_centroids"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = _rows(cols, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert got == _rows(ocols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["topic", "rank", "word", "weight"]
