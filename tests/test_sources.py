"""Files written and read back, and the entity and job tables built from them."""

import json

from pyspark.sql import functions as F

from strandwise import sources
from strandwise.plans import chapters, entities, jobs


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", then\nleave', None), (2, "中文", 1.5)]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    sources.write_csv(df, str(tmp_path / "c"))
    back = sources.read_csv(spark, str(tmp_path / "c"), "id long, text string, x double", multiline=True)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_without_header_and_row_numbers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("王林\n李慕婉\n")
    names = sources.read_csv(spark, str(tmp_path / "n.csv"), "name string", header=False)
    numbered = sources.numbered_rows(names)
    assert [(r.name, r.row) for r in numbered.orderBy("row").collect()] == [("王林", 0), ("李慕婉", 1)]



def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    """Spark packs the largest split first; numbers follow the paths all the same."""
    (tmp_path / "f").mkdir()
    wanted = []
    for name, n in (("a", 10), ("b", 3_000), ("c", 60_000)):
        lines = [f"{name}{i}" for i in range(n)]
        wanted += lines
        (tmp_path / "f" / f"{name}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    rows = sources.numbered_rows(sources.read_csv(spark, str(tmp_path / "f"), "name string", header=False)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in sorted(rows, key=lambda r: r.row)] == wanted and {r.row for r in rows} == set(range(len(wanted)))


def test_json_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"label": "Positive", "score": 0.9}, {"label": "Negative", "score": 0.2}]))
    got = sources.read_json(spark, str(tmp_path / "s.json"), "label string, score double", multiline=True)
    assert sorted(r.label for r in got.collect()) == ["Negative", "Positive"]


def test_xml_records(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        '<HealthData><Record type="Sleep" value="Core" startDate="2022-10-01 23:00:00 +0800"/>'
        '<Record type="Steps" value="12" startDate="2022-10-02 08:00:00 +0800"/></HealthData>'
    )
    df = sources.read_records_xml(spark, str(tmp_path / "e.xml"), "Record", "type string, value string, startDate string")
    assert sorted((r.type, r.value) for r in df.collect()) == [("Sleep", "Core"), ("Steps", "12")]
    us = df.where("type = 'Sleep'").select(F.unix_micros(F.to_timestamp("startDate", "yyyy-MM-dd HH:mm:ss Z"))).first()[0]
    assert us == 1_664_636_400_000_000


def test_frames(spark):
    a = spark.createDataFrame([(1, [("x", "PERSON")])], "id long, e array<struct<name:string,type:string>>")
    assert [tuple(r) for r in sources.flatten_frames(a, "e", ["id"]).collect()] == [(1, "x", "PERSON")]
    b = spark.createDataFrame([("y",)], "name string")
    both = sources.stack_frames([sources.flatten_frames(a, "e"), b])
    assert sorted(tuple(r) for r in both.collect()) == [("x", "PERSON"), ("y", None)]
    left = spark.createDataFrame([(1, "p")], "k long, a string")
    right = spark.createDataFrame([(1, "q")], "k long, b string")
    assert [tuple(r) for r in sources.bind_by_key([left, right], "k").collect()] == [(1, "p", "q")]


def test_entity_tables(spark):
    lists = spark.createDataFrame([([["王 林", "PERSON"], ["趙國", "GPE"]],), ([],)], "e array<array<string>>")
    a = entities.entities_from_lists(lists, "e")
    assert {(r.term, r.type) for r in a.collect()} == {("王林", "PERSON"), ("趙國", "GPE")}
    texts = ['```json\n[["王林", "李"], ["恆岳派"]]\n```', "not json", "[[], []]"]
    b = entities.entities_from_json(spark.createDataFrame([(t,) for t in texts], "r string"), "r")
    assert {(r.term, r.type) for r in b.collect()} == {("王林", "PERSON"), ("李", "PERSON"), ("恆岳派", "LOC")}
    merged = entities.merged_entities(a, b, spark.createDataFrame([("!x", "PERSON")], "term string, type string"), illegal=1)
    assert {r.name for r in entities.people(merged, 2).collect()} == {"王林"}
    frames = [("王林", "PERSON"), ("王林", "PERSON"), ("a林", "PERSON"), ("林", "PERSON"), ("趙國", "DATE"), ("山門", None)]
    got = entities.entity_counts(spark.createDataFrame(frames, "name string, type string"))
    assert [(r.name, r.n) for r in got.collect()] == [("王林", 2)]


def test_job_tables(spark):
    topics = spark.createDataFrame(
        [("j1", 1, "d1", 9, "['NLP']"), ("j1", 2, "d1", 9, "['NLP']"), ("j1", 3, "d2", 1, "['SQL']"), ("j2", 4, "d", -1, "['None']")],
        "id string, index long, desc string, topic_id long, openai string",
    )
    infos = spark.createDataFrame([("j1", "半導體", "None", "", "台北市大安區", True), ("j3", "x", "2", "", "y", False)],
                                  "id string, industry string, experience string, education string, region string, management boolean")
    cats = spark.createDataFrame([("j1", "second", 2), ("j1", "first", 1)], "id string, category string, row long")
    pay = spark.createDataFrame([("j1", "年薪 60 萬", 600000.0)], "id string, salary string, salary_min double")
    t = jobs.job_topics(topics)
    assert t.count() == 2
    info = jobs.job_info(infos, topics, cats, {"半導體": "製造業"})
    out = jobs.job_summary(info, t, pay).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.industry, r.district, r.min_experience, r.category, r.desc, r.salary) == ("Manufacturing", "Daan", "0", "first", "d1", 50000.0)
    assert r.topic_name == '[["NLP","SQL"]]' and r.topic_category == '[["AI/ML","Database/SQL"]]'
    assert jobs.topic_map(spark).count() == 26
    assert [(x.region, x.n) for x in jobs.category_overlap(info, t).collect()] == [("A&C", 1)]


def test_sentence_table(spark):
    docs = spark.createDataFrame([(1, 1, "s")], "id long, title_id long, sentance string")
    topics = spark.createDataFrame([(1, 3, 1.0, "['a', 'b']", "['a']", "['c']", "x - y")], "id long, topic_id long, prob double, rep_ori string, rep_keybert string, rep_mmr string, top_words string")
    mood = spark.createDataFrame([(1, "Positive")], "id long, sentiment_label string")
    s = chapters.sentence_table(docs, topics, mood)
    r = s.first()
    assert r.rep_ori == ["a", "b"] and r.top_words == ["x", "y"]
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    assert [x.name for x in chapters.segment_keywords(s, 1, names).collect()] == ["a"]
