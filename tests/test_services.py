import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.repair import read_json
from quillgraph.operators import ann, context, graph, kv, merge, ranking, vector
from quillgraph.plans import policies, prompts, services
from quillgraph.plans.engine import NO_ANSWER, Engine
from quillgraph.sources import documents
from quillgraph.sources.store import InvalidStorageUsageError, Store
from quillgraph.sources.tenants import Tenants


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', {"a": 1}),
    ('Here it is:\n```json\n{"a": [1, 2,], "b": "x"}\n```\nDone.', {"a": [1, 2], "b": "x"}),
    ("{'a': 'it's here', b: True, \"c\": None}", {"a": "it's here", "b": True, "c": None}),
    ('{"entities": [{"name": "A", "desc": "cut o', {"entities": [{"name": "A", "desc": "cut o"}]}),
    ('{"x": "he said "hi" to me"}', {"x": 'he said "hi" to me'}),
    ("[1, [2, 3", [1, [2, 3]]),
])
def test_json_is_repaired(text, want):
    assert read_json(text) == want


def test_text_without_json():
    with pytest.raises(ValueError):
        read_json("nothing here")


class Clock:
    def __init__(self):
        self.t, self.slept = 0.0, []

    def now(self):
        return self.t

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.t += seconds


def calls(**limits):
    clock = Clock()
    return services.Calls(services.Limits(**limits), clock.sleep, clock.now), clock


def test_failing_calls_are_repeated():
    c, clock = calls(attempts=4, first_wait=4, longest_wait=10)
    answers = iter([ValueError("busy"), None, ValueError("busy"), "yes"])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert c.one(call) == "yes" and clock.slept == [4, 8, 10]
    c, clock = calls(attempts=2)
    with pytest.raises(services.NoResponseError):
        c.one(lambda: None)
    assert clock.slept == [4]


def test_calls_keep_to_rates():
    c, clock = calls(per_second=2, per_minute=5)
    begun = []
    for _ in range(11):
        c.one(lambda: begun.append(clock.t) or 1)
    assert begun[:5] == [0, 0, 1, 1, 2] and begun[5] == 60 and begun[10] >= 120
    for span, most in ((1, 2), (60, 5)):
        assert all(sum(t <= u < t + span for u in begun) <= most for t in begun)


def test_calls_in_order_with_their_failures():
    c, _ = calls(attempts=1, at_once=3)
    out = list(c.each(lambda x: 1 // x, [1, 0, -1]))
    assert out[0] == 1 and isinstance(out[1], ZeroDivisionError) and out[2] == -1


class Script:
    """A chat that gives these answers one after another and keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def reply(self, messages):
        self.asked.append(messages)
        return self.answers.pop(0)


ONE = '{"entities": [{"name": "a", "type": "t", "desc": "d"}, {"type": "nameless"}], "relationships": [{"source": "a", "target": "b", "desc": "r"}, {"source": "a"}], "other_relationships": [{"source": "b", "target": "c"}]}'
MORE = '```{"entities": [{"name": "b"}], "relationships": []}```'


@pytest.mark.parametrize("gleanings, answers, entities", [(0, [ONE], 1), (1, [ONE, MORE], 2), (3, [ONE, MORE, '{"status": "continue"}', MORE, '{"status": "done"}'], 3)])
def test_gleaning(gleanings, answers, entities):
    chat = Script(*answers)
    found = services.ChatExtractor(chat, ["T", "U"], "places", ["where?"], gleanings).subgraph("the text")
    assert len(found[0]) == entities and found[1] == [("a", "b", "r"), ("b", "c", "")] and not chat.answers
    assert chat.asked[0][0]["role"] == "system" and "T,U" in chat.asked[0][0]["content"] and chat.asked[0][-1]["content"].endswith("the text")
    assert all(later[: len(chat.asked[0])] == chat.asked[0] for later in chat.asked)  # the conversation goes on


def test_chat_services():
    assert services.ChatExtractor(Script('{"named": ["A"], "generic": ["b"]}'), []).question("?") == (["A"], ["b"])
    assert services.ChatSummariser(Script('{"description": "short"}')).shorten("long " * 99, 10) == "short"
    assert services.ChatGrouper(Script('{"groups": [{"ids": [0, "1", "x"], "description": "both"}, {"ids": 3}]}'))(["a", "b"]) == [([0, 1], "both")]
    chat = Script("the answer [1]")
    assert services.ChatWriter(chat).answer("q {x}", "c") == "the answer [1]" and "q {x}" in chat.asked[0][-1]["content"]
    for bad in ("", None, "no json"):
        with pytest.raises(services.NoResponseError):
            services.ChatSummariser(Script(bad)).shorten("x", 1)
    assert prompts.types_text(["A", "B"]) == "A,B"


def test_all_sentences():
    s = services.AllSentences()
    assert s.shorten("One. Two! One.\nThree is long.", 16) == "One. Two!" and s.shorten("One. Two! One.\nThree.", 99) == "One. Two! Three." and s.shorten("x" * 20, 5) == "xxxxx"


class Moody(services.RuleExtractor):
    def subgraph(self, text):
        if "broken" in text:
            raise RuntimeError("no")
        return super().subgraph(text)


class Wide(services.HashingEmbedder):
    def encode(self, texts):
        return super().encode(texts)[:, :-1]


FAST = services.Limits(attempts=2, first_wait=0.0)


def test_a_failing_chunk_drops_its_document(spark):
    rows = [(1, 10, 0, "Ada met Bob."), (1, 11, 1, "broken"), (2, 12, 0, "Cyd met Dan.")]
    found = services.extract(spark.createDataFrame(rows, "doc_id long, id long, pos int, content string"), Moody(), FAST)
    assert [r["chunk_id"] for r in found.where("kind = 'failed'").collect()] == [11]
    assert {r["doc_id"] for r in services.whole_documents(found).collect()} == {2}


def test_size_of_embeddings_is_checked(spark):
    texts = spark.createDataFrame([("a b",), (None,)], "text string")
    assert services.embed(texts, services.HashingEmbedder(8)).select(F.size("embedding")).distinct().first()[0] == 8
    with pytest.raises(Exception, match="dimensions"):
        services.embed(texts, Wide(8), limits=FAST).collect()


SCHEMA = "doc_id long, text string, metadata string"


def test_order_of_arrival_is_by_number(spark, tmp_path):
    """Documents 1, 2 and 10, and mentions within a chunk, in that order; then the stored description, and a summary of what is too long."""
    texts = {1: "Zoe knows Ann. First of Zoe.", 2: "Second Zoe came.", 10: "Tenth Zoe went."}
    e = Engine(spark, str(tmp_path / "g"), extractor=Named(), policies=policies.Policies(limit=60))
    e.insert(spark.createDataFrame([(i, t, None) for i, t in sorted(texts.items(), reverse=True)], SCHEMA))
    got = {r["name"]: r["description"] for r in e.tables()["entities"].collect()}
    assert got["ZOE"] == "one0\none1\ntwo0\nten0"
    e.insert(spark.createDataFrame([(20, "Twenty times Zoe.", None)], SCHEMA))
    got = {r["name"]: r["description"] for r in e.tables()["entities"].collect()}
    assert got["ZOE"].split("\n") == ["twenty0", "one0", "one1", "two0", "ten0"]
    e.policies.limit = 20
    e.insert(spark.createDataFrame([(21, "Second and again Zoe.", None)], SCHEMA))
    got = {r["name"]: r["description"] for r in e.tables()["entities"].collect()}
    assert len(got["ZOE"]) <= 20 and got["ZOE"] == "two0 twenty0 one0"


class Named(services.RuleExtractor):
    """Says Zoe as often as the text does, and which time it is."""

    def subgraph(self, text):
        key = {"Zoe": "one", "Sec": "two", "Ten": "ten", "Twe": "twenty"}[text[:3]]
        return [("zoe", "PHRASE", f"{key}{i}") for i in range(text.count("Zoe"))], []


class Sad:
    def answer(self, question, context):
        raise RuntimeError("no model")


class Loud:
    def answer(self, question, context):
        return question.upper()


def test_policies_and_failing_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ada met Bob. Ada knew Bob well.", None), (2, "Ada saw Bob in London.", None), (3, "broken", None)], SCHEMA)
    asked = spark.createDataFrame([(1, "Who met Ada?"), (2, None)], "query_id long, text string")
    e = Engine(spark, str(tmp_path / "g"), extractor=Moody(), limits=FAST, writer=Loud())
    e.policies = policies.Policies(nodes=policies.last_nodes, edges=policies.added_edges, entities=ranking.identity, search=ann.searcher(2))
    assert e.insert(docs)[2] == 2  # the document that failed stays unknown
    assert {r["description"] for r in e.tables()["entities"].where("name = 'ADA'").collect()} == {"Ada saw Bob in London"}
    assert e.nodes(["ADA", "NOBODY"]) == [("ADA", "PHRASE", "Ada saw Bob in London"), None]
    rows = {r["query_id"]: r["response"] for r in e.query(asked).collect()}
    assert rows == {1: "WHO MET ADA?", 2: NO_ANSWER}
    e.writer = Sad()
    with pytest.raises(Exception, match="no model"):
        e.query(asked).collect()
    half = Engine(spark, str(tmp_path / "h"), limits=FAST)
    half.policies = policies.Policies(relations=lambda scores: scores.where("false"))
    half.insert(docs)
    assert half.contexts(asked.where("text IS NOT NULL"))[1].count() == 0


def test_edges_by_name_and_by_position(spark):
    entities = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    none = spark.createDataFrame([], "edge_id long, source string, target string, description string, chunks array<long>")
    named = spark.createDataFrame([(1, "a", "b", "d", [1]), (2, "a", "b", "d", None)], none.schema)
    placed = spark.createDataFrame([(3, 2, 0, "e", [2])], "edge_id long, source_pos long, target_pos long, description string, chunks array<long>")
    both = graph.insert_edges(graph.insert_edges(none, named), placed, entities)
    assert sorted((r["edge_id"], r["source"], r["target"]) for r in both.collect()) == [(1, "a", "b"), (2, "a", "b"), (3, "c", "a")]
    assert graph.insert_edges(named, none).count() == 2
    for wrong in (named.withColumns({"source_pos": F.lit(0), "target_pos": F.lit(1)}), placed.drop("target_pos")):
        with pytest.raises(ValueError):
            graph.insert_edges(none, wrong, entities)


def test_groups_of_a_careless_model():
    edges = [{"edge_id": i, "description": str(i), "chunks": [i]} for i in range(3)]
    assert merge.apply_groups(edges, [([-1, 0], "x"), ([0, 7], "y")]) == edges
    assert [e["edge_id"] for e in merge.apply_groups(edges, [([2, -3, 0], "x")])] == [1, 2]


def test_ragged_vectors_are_refused(spark):
    store = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="components"):
        vector.knn(store.select(F.col("id").alias("query_id"), "embedding"), store, 1).collect()
    with pytest.raises(Exception, match="components"):
        vector.knn(store.where("id = 2").select(F.col("id").alias("query_id"), "embedding"), store.where("id = 1"), 1).collect()


def test_identity_edges_of_fresh_entities_only(spark):
    rows = [(1, "A", [1.0, 0.0]), (2, "B", [1.0, 0.01]), (3, "C", [0.0, 1.0]), (4, "D", [0.01, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, name string, embedding array<float>")
    none = spark.createDataFrame([], "source string, target string")
    pairs = lambda fresh: sorted((r["source"], r["target"]) for r in merge.identity_edges(vectors, none, fresh=fresh).collect())
    assert pairs(None) == [("A", "B"), ("C", "D")] and pairs(vectors.where("id = 4")) == [("C", "D")] and pairs(vectors.where("id IN (1, 2)")) == [("A", "B")]


def test_tenants_of_any_size(spark, monkeypatch):
    """Cells within a tenant do not change what is found."""
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i % 5 else f"t{i % 3}", rng.normal(size=4).tolist()) for i in range(300)]
    store = spark.createDataFrame(rows, "id long, tenant string, embedding array<double>")
    asked = store.where("id % 10 = 0 OR id < 4").withColumnRenamed("id", "query_id")
    got = lambda: sorted((r["tenant"], r["query_id"], r["rank"], r["id"]) for r in vector.tenant_query(asked, store, 3).collect())
    whole = got()
    monkeypatch.setattr(vector, "CANDIDATES_PER_CELL", 20)
    monkeypatch.setattr(vector, "QUERIES_PER_CELL", 3)
    assert got() == whole
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    for q in (1, 30):
        tenant = rows[q][1]
        best = sorted((i for i, t, _ in rows if t == tenant), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:3]
        assert [r[3] for r in whole if r[1] == q] == best


def test_ann_finds_what_a_full_search_finds(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(5000, None)]
    store = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = store.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = ann.build(store, 30)
    assert index.cells.count() == 1500 and len(index.centres) == 30
    exact = vector.knn(asked, store, 5)
    assert ann.recall(ann.search(index, asked, 5, 8), exact) >= 0.95
    every = sorted(map(repr, ann.search(index, asked, 5, 30).select("query_id", "id", "rank", F.round("score", 9)).collect()))
    assert every == sorted(map(repr, exact.select("query_id", "id", "rank", F.round("score", 9)).collect()))
    assert ann.search(ann.build(store.limit(0)), asked, 5).count() == 0


def test_pagerank_of_many_questions_is_dealt_out(spark):
    """Questions are solved in several tasks, and as by joins."""
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (150, 2)).tolist()], "source string, target string")
    seeds = spark.createDataFrame([(q, f"n{n}", 1.0 + q % 3) for q in range(40) for n in rng.integers(0, 70, 2).tolist()], "query_id long, name string, weight double")
    local = graph.personalized_pagerank(edges, seeds, 8)
    assert local.select(F.spark_partition_id()).distinct().count() > 1
    joined = graph.personalized_pagerank(edges, seeds, 8, local_edges=0)
    a, b = ({(r["query_id"], r["idx"]): r["score"] for r in df.collect()} for df in (local, joined))
    assert {k for k, v in a.items() if v > 1e-12} == {k for k, v in b.items() if v > 1e-12} and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_free_indices_of_a_large_store(spark):
    store = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("idx"), F.lit("v").alias("value"))
    new = spark.createDataFrame([(i, f"n{i}", "w") for i in range(5)], "ord long, key string, value string")
    rows = {r["key"]: r["idx"] for r in kv.upsert(store, new).collect()}
    assert [rows[f"n{i}"] for i in range(5)] == [2996, 2995, 2993, 2992, 2990] and len(set(rows.values())) == 1005
    assert kv.upsert(store.limit(0), new).agg(F.max("idx")).first()[0] == 4


def test_tenant_stores(spark, tmp_path):
    t = Tenants(spark, str(tmp_path / "tenants"))
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    assert t.names() == [] and not t.contains("a")
    t.create("a")
    t.create("b")
    t.upsert("a", rows)
    t.upsert("a", rows.where("id = 1"))
    t.append("b", rows)
    t.append("b", rows)
    t.put_data("a", made="today", n=2)
    assert t.names() == ["a", "b"] and t.get("a").count() == 2 and t.get("b").count() == 4 and t.data("a") == {"made": "today", "n": 2} and t.data("b") == {}
    asked = rows.where("id = 2").withColumnRenamed("id", "query_id")
    assert [r["id"] for r in t.query("a", asked, 1).collect()] == [2]
    t.remove("a", rows.where("id = 2").select("id"))
    assert [(r["id"], r["embedding"]) for r in t.get("a").collect()] == [(1, [0.6, 0.8])]
    t.delete("b")
    assert t.names() == ["a"]
    for wrong in (lambda: t.get("b"), lambda: t.create("a"), lambda: t.create("../x"), lambda: t.data("b")):
        with pytest.raises(InvalidStorageUsageError):
            wrong()


def test_a_passing_fault_sets_no_version_aside(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    version = store.commit({"t": spark.range(2)})
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda *a, **k: (_ for _ in ()).throw(OSError("connection reset")))
    with pytest.raises(OSError):
        store.load(["t"])
    monkeypatch.setattr(type(spark.read), "parquet", read)
    assert store.versions() == [version] and store.load(["t"])["t"].count() == 2


def test_results_and_titles(spark, tmp_path):
    rows = spark.createDataFrame([("q1", ["T1"], 0.5), ("q2", [], None)], "question string, evidence array<string>, score double").coalesce(1)
    documents.write_results(rows, str(tmp_path / "r.json"))
    text = (tmp_path / "r.json").read_text()
    assert json.loads(text) == [r.asDict() for r in rows.collect()] and '\n        "question": "q1"' in text
    items = "\n".join(f"[{i}]  Title {i}: the text: of it\n=====\n\n" for i in range(1, 12))
    df = spark.createDataFrame([(context._LIST.format("Sources", items),), ("\n## Sources: Not provided\n",), (None,)], "c string").coalesce(1)
    assert [r[0] for r in df.select(documents.titles_in(F.col("c"))).collect()] == [[f"Title {i}" for i in range(1, 9)], [], None]


def test_answers_are_mended_before_they_are_read(spark):
    rows = spark.createDataFrame([(1, "Sure: {'entities': [{'name': 'a', 'type': 't', 'desc': 'd'},], 'relationships': []"), (2, "nothing"), (3, None)], "doc_id long, json string")
    entities, _, bad = documents.parse_subgraph(rows.withColumn("json", documents.repaired("json")))
    assert [(r["doc_id"], r["name"]) for r in entities.collect()] == [(1, "A")] and sorted(r["doc_id"] for r in bad.collect()) == [2, 3]
