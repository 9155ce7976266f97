"""Source and sink round trips."""

import json
import os

from pyspark.sql import functions as F

from tagloom.sources import files as SF


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, "b, c")], "dataset_id long, text string")
    SF.write_docs_csv(df, f"{tmp_dir}/csv")
    back = SF.read_docs_csv(spark, f"{tmp_dir}/csv", "dataset_id long, text string")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_text_by_id(spark, tmp_dir):
    for i, t in ((12, "first\ntext"), (7, "second")):
        with open(f"{tmp_dir}/dataset_{i}.txt", "w") as f:
            f.write(t)
    got = sorted(tuple(r) for r in SF.read_text_by_id(spark, f"{tmp_dir}/dataset_*.txt").collect())
    assert got == [(7, "second"), (12, "first\ntext")]


def test_text_files_are_dealt_to_tasks(spark, tmp_dir, monkeypatch):
    """one split of many texts is written by as many tasks as its files need."""
    monkeypatch.setattr(SF, "FILES_A_TASK", 20)
    texts = spark.range(200, numPartitions=1).selectExpr("id AS dataset_id", "concat('t', id) AS prompt_description")
    SF.write_text_by_id(texts, f"{tmp_dir}/texts")
    files = [f for _, _, names in os.walk(f"{tmp_dir}/texts") for f in names if f.startswith("part-")]
    assert len(files) == 200 and len({f[:10] for f in files}) == 10
    assert SF.read_text_partitioned(spark, f"{tmp_dir}/texts").count() == 200
    twice = texts.filter("dataset_id < 3").union(texts.filter("dataset_id < 2")).coalesce(1)
    SF.write_text_by_id(twice, f"{tmp_dir}/twice")
    assert SF.read_text_partitioned(spark, f"{tmp_dir}/twice").count() == 5


def test_items_and_runs(spark, tmp_dir):
    with open(f"{tmp_dir}/items.json", "w") as f:
        json.dump([{"dataset_id": 1, "url": "u", "scraped_data": "s"}], f)
    it = SF.read_items(spark, f"{tmp_dir}/items.json", "dataset_id long, url string, scraped_data string")
    assert it.first()["scraped_data"] == "s"
    os.makedirs(f"{tmp_dir}/runs")
    rec = {"Dataset": "d", "Dataset Size": 3, "Model": "m", "Params": {"nr_topics": "10"},
           "Scores": '{"npmi": 0.1}', "Computation Time": 1.5}
    for name in ("a.json", "b.json", "metadata.json"):
        with open(f"{tmp_dir}/runs/{name}", "w") as f:
            json.dump([rec, rec], f)
    runs = SF.read_runs(spark, f"{tmp_dir}/runs")
    assert runs.count() == 4
    assert sorted({r["file_index"] for r in runs.collect()}) == [0, 1]


def test_payload_folder(spark, tmp_dir):
    with open(f"{tmp_dir}/3.json", "w") as f:
        f.write('{"topic": {"themes": ["a"], "overarching_themes": []}, "texts": {"1": {"a": 0.9}}}')
    with open(f"{tmp_dir}/4.json", "w") as f:
        f.write('{"topic": {"themes": ["a"')
    ok, bad = SF.read_topic_payloads(spark, tmp_dir)
    assert [r["topic_id"] for r in ok.collect()] == [3]
    assert [r["topic_id"] for r in bad.collect()] == [4]


def test_nested_tags_and_append(spark, tmp_dir):
    tags = spark.createDataFrame([(1, "themes", "a", 0.9), (1, "overarching_themes", "b", 0.6), (2, "themes", "c", 0.7)],
                                 "dataset_id long, kind string, tag string, score double")
    nested = {r["dataset_id"]: json.loads(r["json"]) for r in SF.nest_tags(tags).collect()}
    assert nested[1] == {"themes": {"a": 0.9}, "overarching_themes": {"b": 0.6}}
    assert nested[2] == {"themes": {"c": 0.7}, "overarching_themes": {}}
    SF.append_records(tags, f"{tmp_dir}/log")
    SF.append_records(tags, f"{tmp_dir}/log")
    assert spark.read.json(f"{tmp_dir}/log").count() == 6


def test_timings_and_corpus(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/t")
    for m in ("lda", "nmf"):
        with open(f"{tmp_dir}/t/{m}.csv", "w") as f:
            f.write("nr_topics,seconds\n10,1.5\n")
    t = SF.read_timings(spark, f"{tmp_dir}/t")
    assert sorted(r["Model"] for r in t.collect()) == ["lda", "nmf"]
    docs = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    SF.save_corpus(docs, f"{tmp_dir}/corpus")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_dir}/corpus").collect()) == ["a b", "c"]


def test_route_by_domain(spark, tmp_dir):
    df = spark.createDataFrame([(1, "https://x.uci.edu/a"), (2, "https://kaggle.com/b"), (3, "http://other")],
                               "dataset_id long, url string")
    r = SF.route_by_domain(df, "url", {"uci": "uci.edu", "kaggle": "kaggle"})
    SF.write_by_site(r, f"{tmp_dir}/sites")
    back = spark.read.json(f"{tmp_dir}/sites").filter(F.col("site") == "uci")
    assert [x["dataset_id"] for x in back.collect()] == [1]


def test_written_files_are_read_back(spark, tmp_dir):
    texts = [(1, "two\nlines\n"), (2, ""), (30, "caf\u00e9 \r\n end"), (4, None)]
    SF.write_text_by_id(spark.createDataFrame(texts, "dataset_id long, prompt_description string"), f"{tmp_dir}/texts")
    back = {tuple(r) for r in SF.read_text_partitioned(spark, f"{tmp_dir}/texts").collect()}
    assert back == {(i, t or "") for i, t in texts}
    recs = [("b.json", 2, "d", "m2"), ("b.json", 1, "d", "m1"), ("a.json", 9, "e", None), ("metadata.json", 1, "d", "no")]
    SF.write_runs(spark.createDataFrame(recs, "file string, pos int, Dataset string, Model string"), f"{tmp_dir}/runs")
    runs = SF.read_runs(spark, f"{tmp_dir}/runs").select("file", "file_index", "pos", "Dataset", "Model").collect()
    assert sorted(map(tuple, runs), key=str) == [("a.json", 0, 0, "e", None), ("b.json", 1, 0, "d", "m1"), ("b.json", 1, 1, "d", "m2")]
    times = [("a b", 10, 1.5), ("7", 20, 2.5), ("7", 30, None)]
    SF.write_timings(spark.createDataFrame(times, "Model string, nr_topics int, seconds double"), f"{tmp_dir}/times")
    t = SF.read_timings(spark, f"{tmp_dir}/times").select("Model", "nr_topics", "seconds").collect()
    assert {tuple(r) for r in t} == {("a b", "10", "1.5"), ("7", "20", "2.5"), ("7", "30", None)}


def test_texts_by_id_are_read_in_few_tasks(spark, tmp_dir):
    """A task reads and lists many of the small files; settings of the caller's session stay."""
    rows = [(i, f"text {i}\nof two lines") for i in range(300)]
    SF.write_text_by_id(spark.createDataFrame(rows, "dataset_id long, prompt_description string"), f"{tmp_dir}/texts")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    back = SF.read_text_partitioned(spark, f"{tmp_dir}/texts")
    assert back.rdd.getNumPartitions() <= 8  # 4 files of 4 MB made a task, or 32 of them
    assert sorted(map(tuple, back.collect())) == rows and spark.conf.get("spark.sql.files.openCostInBytes") == before
    joined = spark.createDataFrame([(7,)], "dataset_id long").join(back, "dataset_id").collect()
    assert [tuple(r) for r in joined] == [(7, "text 7\nof two lines")]
