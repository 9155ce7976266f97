"""Training-data operators against plain restatements, on hand-made rows:
nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import hashlib
import random

import brute as B
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagloom.llm import (bpe, chat_format, embedding_dedup, language_id, line_dedup, lm_score, packing, quality_rules,
                         simhash, toxicity)
from tagloom.llm.common import components, fold, table
from tagloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, content string, h long"


def _rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta.", "épée", "ñu", "x1", "###", "La", "the", "of"]
    line = "a line that many documents of this host share word for word"
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
        if i % 2:
            text += "\n" + ("  " + line.upper() + "\t" if i % 3 else line)
        rows.append((i, text, rng.choice(["en", "fr", None]), f"s{i % 2}"))
    base = " ".join(rng.choice(words) + str(k) for k in range(200))
    for k in range(30):  # copies and near copies
        rows.append((100 + k, base if k % 2 else base + f" tail{k}", "en", "s0"))
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \t\n \n", None, "s1"), (None, "null id text here", "en", "s1"),
             (203, "one", "en", "s1"), (204, "one two", "en", "s1"), (205, "w " * 12000, "en", "s1"),
             (206, "Same Line\nsame line \nSame Line", "en", "s1"), (207, "a b c d e a b c d e f g", "en", "s0"),
             (207, "a b c d e a b c d e f g", "en", "s0"), (208, "<|endoftext|> he's I'LL 12,5　x \x85y", "en", "s0"),
             (209, "q" * 700 + "é" * 50, "en", "s0")]
    return [(i, t, lang, s, len(t or ""), "host", "content", 7) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, columns, expected):
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, expected), key=repr)


def test_quality_rules(docs, rows, empty):
    exp = B.quality([(r[0], r[1], r[3]) for r in rows], 20, 0.3)
    same(quality_rules.decide(docs), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "n_removed_words"],
         [(r[0], *e) for r, e in zip(rows, exp)])
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(e[6] for e in exp)
    assert quality_rules.decide(empty).count() == 0 and quality_rules.clean(empty).count() == 0


def test_quality_rules_removes_common_lines(spark):
    shared = "this line stands on every page of the host and carries nothing"
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(20))
    rows = [(i, f"{own(i)}\n{shared}", None, "h", 0, "", "", 0) for i in range(30)]
    rows += [(50 + i, f"{shared}\nshort tail {i}", None, "h", 0, "", "", 0) for i in range(5)]
    got = {r["doc_id"]: r for r in quality_rules.clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(range(30))  # the depleted ones go
    assert got[0]["text"].endswith(shared) and all(got[i]["text"] == own(i) for i in range(1, 30))


def test_line_dedup(docs, rows, empty):
    exp = B.line_dedup([r[1] for r in rows], 10)
    got = line_dedup.apply(docs, ["doc_id"]).withColumn("sha", F.sha2("kept_text", 256))
    same(got, ["doc_id", "n_lines", "n_dropped", "sha"], [(r[0], *e) for r, e in zip(rows, exp)])
    assert sum(e[1] for e in exp) > 0
    assert line_dedup.clean(docs).columns == docs.columns
    assert line_dedup.apply(empty, ["doc_id"]).count() == 0


def test_line_runs_compact_over_many_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(r, h) for r in range(2) for h in (1, b, 10 + b % 2)], "row long, h long"))
    assert {r["h"] for r in runs.common().collect()} == {0, 1, 10, 11} - {0}


def test_simhash(docs, rows, empty):
    ids = [r[0] if r[0] is not None else 10**9 for r in rows]
    exp = B.simhash_groups(ids, [r[1] for r in rows])
    got = simhash.group(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    same(got, ["doc_id", "f", "component_id"],
         [(r[0], f, None if c == 10**9 else c) for r, (f, c) in zip(rows, exp)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in exp})
    assert simhash.group(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_links_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2**63, 2**63 - 1, 20, dtype=np.int64)
    near = [int(b ^ np.int64(np.uint64(1 << int(i) | 1 << int(j)).astype(np.int64)))
            for b in base for i, j in rng.integers(0, 64, (6, 2))]
    fps = sorted({*map(int, base), *near})
    u = np.array(fps, np.int64).view(np.uint64)
    exp = B.reach(fps, np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    got = components(simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")))
    comp = {r["node"]: r["component"] for r in got.collect()}
    assert [comp.get(f, f) for f in fps] == exp


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    exp = B.packed_pieces([r[0] for r in rows], [r[1] for r in rows], tok)
    cut = packing.pieces(docs, path)
    got = packing.pack(cut.withColumn("crc", F.crc32("ids"))).cache()
    same(got, ["doc_id", "piece", "start", "length", "crc"], exp)
    for r in got.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p")).collect():
        at = 0
        for o, n in r["p"]:
            assert o == at
            at += n
        assert at <= 2048
    assert packing.sequences(got).count() == got.select("sequence_id").distinct().count()
    assert packing.pack(packing.pieces(empty, path).drop("ids")).count() == 0


def test_packing_joins_short_pieces_of_all_groups(spark):
    short = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(20).cast("long").alias("length"))
    assert packing.pack(short).select("sequence_id").distinct().count() == -(-60_000 // (2048 // 20))  # the least there can be


def test_best_fit_takes_the_tightest_sequence():
    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    seq, off = packing.best_fit(lengths, 100)
    room, exp = {}, []
    for n in lengths:
        fits = [(r, s) for s, r in room.items() if r >= n]
        best = min(fits)[0] if fits else None
        exp.append(best)
        s = seq[len(exp) - 1]
        assert room.get(s) == best and off[len(exp) - 1] == 100 - (best or 100)
        room[s] = (best or 100) - n


def test_byte_bpe(docs, rows, empty):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exp = [(r[0], bytearray(np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()), bytearray((r[1] or "").encode()))
           for r in rows]
    same(bpe.round_trip(docs, path, P.PATTERN), ["doc_id", "ids", "decoded"], exp)
    same(bpe.decode(bpe.encode(docs, path, P.PATTERN), path), ["doc_id", "ids", "decoded"], exp)
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 8))
    vectors = [v.tolist() for v in np.vstack([base, base[:10] + 0.15 * rng.standard_normal((10, 8)), base[:5] * 3])]
    vectors += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0],
                [2.0, 4.0], vectors[0], vectors[0]]
    ids = list(range(len(vectors)))
    exp = B.cosine_groups(ids, vectors)
    df = spark.createDataFrame([(i, v, 1, 9) for i, v in zip(ids, vectors)],
                               "vec_id long, embedding array<double>, label int, node long").repartition(3)
    for tile in (4096, 7):  # many cells and tiles give the same links
        same(embedding_dedup.group(df, tile=tile), ["vec_id", "n_links", "component_id", "kept"],
             [(i, n, c, i == c) for i, (n, c) in zip(ids, exp)])
    assert embedding_dedup.group(df.limit(0)).count() == 0


def test_embedding_dedup_sends_a_vector_once(spark, monkeypatch):
    """Vectors that cannot be pruned lie in one block each, not in one tile per pair of blocks; links across blocks and hot cells are found."""
    rng = np.random.default_rng(6)
    vectors = np.vstack([rng.standard_normal((60, 16)), np.ones((25, 16)) + 0.05 * rng.standard_normal((25, 16))])
    vectors = [v.astype("f4").tolist() for v in vectors] + [[1.0, -0.0], [1.0, 0.0], [-1.0, 0.0]]
    ids, kept = list(range(len(vectors))), {}
    keep = embedding_dedup.staged
    monkeypatch.setattr(embedding_dedup, "staged", lambda df, name, **o: kept.setdefault(name, keep(df, name, **o)))
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>").repartition(3)
    exp = B.cosine_groups(ids, vectors)
    same(embedding_dedup.group(df, tile=7), ["vec_id", "n_links", "component_id", "kept"], [(i, n, c, i == c) for i, (n, c) in zip(ids, exp)])
    nodes = [n for r in kept["vector-blocks"].select("node").collect() for n in r["node"]]
    assert len(nodes) == len(set(nodes)) == 87  # 1, 0 and 1, -0 are one vector
    assert max(len(r["node"]) for r in kept["vector-blocks"].select("node").collect()) <= 20


def test_chat_format(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi\n<|im_end|>\\"), (1, 2, "assistant", "a <|b\\n"),
             (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", None), (2, 0, "user", "only"),
             (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, None, "y"), (None, 1, "we\nird", "z"),
             (4, None, "assistant", "<|im_start|>assistant\nno<|im_end|>\n")]
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, example int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exp = []
    for c in {t[0] for t in turns}:
        own = sorted((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        exp.append((c, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss)))
    each = chat_format.examples(df)
    same(chat_format.digests(each), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"], exp)
    assert each.filter("conv_id = 1").count() == 3  # two replies and the rest
    assert chat_format.examples(df.limit(0)).count() == 0
    assert not any(w in each._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_lm_score(docs, rows, empty):
    pairs = [(r[0], r[1]) for r in rows]
    exp, logs = B.unigram(pairs, 2), B.ppm(pairs, 2)
    got = lm_score.score(docs, fold("doc_id", 7) == 2, block_bytes=5000)
    key = lambda r: (repr(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                                               "score").collect()), key=key)
    exp = sorted(((i, *e, s) for (i, _), e, s in zip(pairs, exp, logs)), key=key)
    for g, e in zip(got, exp, strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], abs=1e-6)
    assert lm_score.score(empty, fold("doc_id", 7) == 2).count() == 0


def test_language_id(spark, docs, rows, empty):
    given = table(spark, SF_SMALL, "documents")
    held_out = fold("doc_id", 5) == 0
    net = language_id.train(given.filter(~held_out), steps=120)
    told = language_id.predict(given, net).join(given.select("doc_id", "lang"), "doc_id").filter(fold("doc_id", 5) == 0)
    hits = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.9
    got = {r["doc_id"]: r for r in language_id.predict(docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len({r[0] for r in rows})
    kept = language_id.keep_known(docs, net)
    assert kept.columns == docs.columns and kept.filter("doc_id in (200, 201, 202)").count() == 0
    assert language_id.train(empty) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_gru_gradient_matches_differences():
    net = language_id.ByteGru(["a", "b"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n, _ = language_id.spans([b"some bytes", b"x" * 140, b"zq"])
    label = np.array([0, 1, 1, 0])[:len(x)]
    _, g = net.gradient(x, n, label)
    for k, at in (("emb", (1, ord("x"))), ("uf", (4, 1)), ("wb", (7, 2)), ("vf", (1, 0)), ("ub", (8, 0)), ("c", (0, 0))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = net.gradient(x, n, label)[0]
        net.p[k][at] = old - 1e-3
        down = net.gradient(x, n, label)[0]
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-5)


def test_toxicity_grammar():
    g = toxicity.Grammar(toxicity.Lexicon(["idiot"], ["lowe"]))
    kinds = lambda text: {toxicity.KINDS[i]: n for i, n in enumerate(g.evidence(text)[:-1]) if n}
    assert kinds("an idiot") == {"insult": 1}
    assert kinds("you idiot, loweich") == {"aimed insult": 1, "insult": 1}
    assert kinds("not an idiot") == {"negated insult": 1}
    assert kinds("not. an idiot") == {"insult": 1}
    assert kinds("they said an idiot") == {"reported insult": 1}
    assert kinds("I will kill you") == {"threat": 1} and kinds("you I kill") == {"aimed threat": 1}
    assert kinds("") == {} and kinds(None) == {}


def test_toxicity_learns(spark, docs, rows, empty):
    train = [(i, f"word{i} plain text of no harm number {i}" + (f" {'abcdefghij'[i // 3 % 10] * 3} vilecreature here" if i % 3 == 0 else ""))
             for i in range(200)]
    df = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got) and len(got) == 200
    assert toxicity.train(df, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0
    told = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(df, labels)).collect()}
    assert told[200] == told[201] < 0.3


def test_toxicity_reads_contracted_negations():
    g = toxicity.Grammar(toxicity.Lexicon(["idiot"], []))
    kinds = lambda text: {toxicity.KINDS[i]: n for i, n in enumerate(g.evidence(text)[:-1]) if n}
    for text in ("you aren't an idiot", "you aren’t an idiot", "you WASN'T an idiot"):
        assert kinds(text) == {"negated insult": 1}
    assert kinds("he's an idiot") == kinds("you're an idiot") == {"aimed insult": 1} and kinds("l'idiot") == {"insult": 1}


def test_toxicity_learns_from_whole_texts_once(spark):
    rows = [(i, "plain word text " * 4000 + f" name{'abcdefghij'[i // 2 % 10] * 3} " + ("vilecreature" if i % 2 else "friend")) for i in range(40)]
    rows += [(1, "copied idea " * 3)] * 50  # an id of many equal rows is one document
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    g = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert g.lexicon["vilecreature"] == toxicity.INSULT and g.lexicon["copied"] == toxicity.OTHER


def test_language_id_draws_from_the_whole_text(spark):
    key, text = 5, "a" * 70_000 + "b" * 700_000
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([1], pa.int32()), pa.array([key]), pa.array([text])],
                                       names=["lang", "n", "key", "text"])
    parts = next(language_id._draw([batch])).column("parts").to_pylist()[0]
    assert len(parts) == language_id.FIT_SPANS and any(b"b" in p for p in parts)


def test_every_query_is_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_lm_needs_in_parts(monkeypatch):
    texts = ["ab ab c", None, "", "xyz " * 50, "ab c"] * 7
    block = pa.table({"block": pa.array([3] * len(texts), pa.int32()), "text": texts,
                      "held_out": [i % 3 == 0 for i in range(len(texts))]})
    whole = lm_score._needs(block)
    monkeypatch.setattr(lm_score, "PART_BYTES", 16)
    assert lm_score._needs(block).equals(whole)
    sums = lm_score.Sums()
    rng = np.random.default_rng(1)
    key = rng.integers(0, 50_000, 400_000)
    for k in np.array_split(key, 40):
        sums.add(*np.unique(k, return_counts=True))
    sums.merge()
    want, n = np.unique(key, return_counts=True)
    assert (sums.key == want).all() and (sums.n == n).all()


def test_byte_bpe_decoder_asks_for_distinct_ids_only():
    """Texts are put together from a batch's distinct tokens, empty ones too."""
    import public_tokenizers

    from tagloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["", "one one one é\U0001f600", "", "one\n"]
    decoder, asked = bpe.Decoder(path), []

    class Db:
        def register(self, name, rows):
            asked.append(rows.num_rows)
            decoder_db.register(name, rows)

        def execute(self, sql):
            return decoder_db.execute(sql)

    decoder_db, decoder.db = decoder.db, Db()
    ids = bpe.Bpe(path, public_tokenizers.PATTERN).encode(texts)
    assert [x.decode() for x in decoder.decode(ids)] == texts and decoder.decode([]) == []
    assert asked[0] < sum(len(x) // 4 for x in ids)
