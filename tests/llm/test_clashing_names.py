"""Pipeline stages keep columns of any name, also names that they use inside."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagloom.llm import line_dedup, quality_rules, simhash
from tagloom.llm.common import table

#: names that the three operators and their helpers use, in both cases of letters
INSIDE = """whole all any row batch h n m drop keys n_lines n_dropped kept_text kept removed words line line_hash line_words
host doc id first n_docs content fp variant low flip best component component_id node a b d t key none _id _text _kept
_host _content _removed base_failed n_words""".split()


@pytest.mark.parametrize("stage", [quality_rules.clean, line_dedup.clean, simhash.keep_one])
@pytest.mark.parametrize("upper", [False, True])
def test_extra_columns_come_through(spark, stage, upper):
    docs = table(spark, SF_SMALL, "documents")
    plain = {r["doc_id"]: r["text"] for r in stage(docs).collect()}
    names = [n.upper() if upper else n for n in INSIDE] + ["with space", "dot.ted"]
    extra = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    got = stage(extra)
    assert got.columns == extra.columns
    rows = got.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
