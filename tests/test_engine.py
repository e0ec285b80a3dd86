import pytest
from pyspark.sql import functions as F

from quillgraph.plans.engine import NO_ANSWER, Engine, Options
from quillgraph.sources import documents
from quillgraph.sources.store import InvalidStorageError, Store

DOCS = [
    (1, "Ada Lovelace worked with Charles Babbage. Charles Babbage designed the Analytical Engine.", '{"title":"one"}'),
    (2, "The Analytical Engine inspired Alan Turing. Alan Turing lived in London.", '{"title":"two"}'),
]
SCHEMA = "doc_id long, text string, metadata string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "graph"))
    assert e.contexts(spark.createDataFrame([(1, "Who?")], "query_id long, text string")) is None
    e.first = e.insert(spark.createDataFrame(DOCS[:1], SCHEMA))
    return e


def test_insert_is_incremental(spark, engine):
    assert engine.first[0] == 3 and engine.first[2] == 1
    assert engine.insert(spark.createDataFrame(DOCS[:1], SCHEMA)) == engine.first
    after = engine.insert(spark.createDataFrame(DOCS, SCHEMA))
    assert after[0] > engine.first[0] and after[2] == 2
    names = {r["name"] for r in engine.tables()["entities"].collect()}
    assert {"ADA LOVELACE", "CHARLES BABBAGE", "ALAN TURING", "LONDON"} <= names


def test_query(spark, engine, tmp_path):
    engine.insert(spark.createDataFrame(DOCS, SCHEMA))
    asked = spark.createDataFrame([(1, "Who was Ada Lovelace?"), (2, " "), (3, "Where did Alan Turing live?")], "query_id long, text string")
    rows = {r["query_id"]: r for r in engine.query(asked, Options(with_references=True)).collect()}
    assert rows[2]["response"] == NO_ANSWER and "ADA LOVELACE" in rows[1]["context"] and rows[1]["response"] == "See [1: 1]."
    assert '"title": "one"' in rows[1]["references"] and '"title": "two"' in rows[3]["references"]
    only = {r["query_id"]: r["response"] for r in engine.query(asked, Options(only_context=True)).collect()}
    assert only[1] == "" and only[2] == NO_ANSWER
    one = engine.query(asked.where("query_id = 3"), Options(with_references=True)).first()
    assert one == rows[3]
    engine.save_graphml(str(tmp_path / "g.graphml"))
    import xml.etree.ElementTree as ET

    root = ET.parse(tmp_path / "g.graphml").getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{ns}node")) == engine.counts()[0] and len(root.findall(f".//{ns}edge")) == engine.counts()[1]


def test_store_rolls_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), keep=2)
    assert store.load(["t"]) is None
    versions = [store.commit({"t": spark.range(n)}) for n in (1, 2, 3)]
    assert versions == sorted(set(versions)) and store.load(["t"])["t"].count() == 3
    for f in (tmp_path / "s" / str(versions[2]) / "t").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "s" / str(versions[2]) / "t").glob(".*.crc"):
        f.unlink()
    assert store.load(["t"])["t"].count() == 2 and (tmp_path / "s" / f"0__err_{versions[2]}").exists()
    store.commit({"t": spark.range(4)})
    assert store.vacuum() == [versions[0]] and store.load(["t"])["t"].count() == 4
    with pytest.raises(InvalidStorageError):
        store.load(["other"])


def test_stream(spark, tmp_path):
    from quillgraph.streaming.insert import event_counts, insert_stream

    spark.createDataFrame(DOCS, SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))
    engine = Engine(spark, str(tmp_path / "graph"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    insert_stream(stream, engine, str(tmp_path / "ckpt")).awaitTermination()
    assert engine.counts()[2] == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in event_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_questions(spark, tmp_path):
    import json

    data = [{"question": "q1", "answer": "a", "context": [["T1", ["s1.", "s2."]], ["T2", ["x"]]], "supporting_facts": [["T1", 0], ["T1", 1]]}, {"question": "q2", "answer": "b", "context": [["T3", ["x"]]], "supporting_facts": []}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    rows = documents.questions(spark, str(tmp_path / "d.json"))
    assert sorted((r["title"], r["text"]) for r in documents.corpus(rows).collect()) == [("T1", "s1.\ns2."), ("T2", "x")]
    assert [tuple(r) for r in documents.queries_of(rows).orderBy("question").collect()] == [("q1", "a", ["T1"]), ("q2", "b", [])]
    assert documents.questions(spark, str(tmp_path / "d.json"), 1).count() == 1


def test_bad_json_is_set_aside(spark):
    rows = spark.createDataFrame([(1, '{"entities": [{"name": "a", "type": "t", "desc": "d"}]}'), (2, "{no")], "doc_id long, json string")
    entities, relations, bad = documents.parse_subgraph(rows)
    assert [(r["name"], r["type"], r["description"]) for r in entities.collect()] == [("A", "T", "d")]
    assert relations.count() == 0 and [r["doc_id"] for r in bad.collect()] == [2]


def test_vector_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    documents.write_vectors_json(df, str(tmp_path / "v"))
    assert [tuple(r) for r in documents.read_vectors_json(spark, str(tmp_path / "v")).collect()] == [(1, [1.0, 2.0])]
