import base64

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import text, vectors
from quillgraph.operators import chunking, context, graph, kv, merge, order, ranking, vector


def scores(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "query_id long, idx long, score double")


def kept(df):
    return sorted(r["score"] for r in df.collect())


def test_ranking(spark):
    assert kept(ranking.threshold(scores(spark, [0.05, 0.2, 0.15, 0.05]), 0.1)) == [0.15, 0.2]
    assert kept(ranking.threshold(scores(spark, [0.05, 0.01]), 0.1)) == []
    assert kept(ranking.threshold(scores(spark, [0.3, 0.2, 0.15]), 0.1, 2)) == [0.2, 0.3]
    five = [0.05, 0.05, 0.2, 0.15, 0.25]
    assert kept(ranking.top_k(scores(spark, five), 2)) == [0.2, 0.25]
    assert kept(ranking.top_k(scores(spark, five), 1)) == [0.25]
    assert kept(ranking.top_k(scores(spark, five), 0)) == sorted(five)
    assert kept(ranking.top_k(scores(spark, [0, 0]), 1)) == []
    assert kept(ranking.elbow(scores(spark, [0.05, 0.2, 0.1, 0.25, 0.1]))) == [0.2, 0.25]
    assert len(kept(ranking.elbow(scores(spark, [0.1] * 5)))) == 4
    assert kept(ranking.elbow(scores(spark, [0.1]))) == [0.1]
    ranked = ranking.sorted_scores(scores(spark, [0, 0.1, 0, 0.7, 0.5, 0])).orderBy("rank").collect()
    assert [(r["idx"], r["score"]) for r in ranked] == [(3, 0.7), (4, 0.5), (1, 0.1)]


def test_fits():
    rows = ["x" * 9] * 20
    count = lambda budgets, first=20: context.fits([(rows[:first], budgets[0]), (rows, budgets[1]), (rows, budgets[2])])
    assert count((35, 35, 35)) == [4, 4, 2]
    assert count((100, 35, 35), 3) == [3, 7, 7]
    assert count((-1, 35, 35)) == [0, 4, 3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 12), max_size=8), st.integers(-1, 60)), min_size=1, max_size=4))
def test_fits_like_a_row_by_row_count(tables):
    """The rule of fits() one row at a time."""
    pool, at, left = 0, [0] * len(tables), [b for _, b in tables]
    go = True
    while go:
        start = pool
        for i, (rows, _) in enumerate(tables):
            turn = left[i] >= 0
            while turn and at[i] < len(rows):
                need = rows[at[i]] + 1
                if need <= pool:
                    pool, turn = pool - need, False
                elif need <= left[i]:
                    left[i] -= need
                else:
                    break
                at[i] += 1
            pool, left[i] = pool + max(left[i], 0), min(left[i], 0)
        go = pool != start
    assert context.fits([(["x" * n for n in rows], b) for rows, b in tables]) == at


def test_context_markup(spark):
    df = spark.createDataFrame([(1, 0, 1, "A\tan a"), (1, 2, 1, "[1]  text\n=====\n\n"), (2, 1, 1, "A\tB\tties")], "query_id long, part int, rank int, line string")
    rows = {r["query_id"]: r["context"] for r in context.truncate_context(df, (100, 100, 100)).collect()}
    assert rows[1] == "\n## Entities\n```csv\nname\tdescription\nA\tan a\n```\n\n## Relationships: Not provided\n\n\n## Sources\n\n[1]  text\n=====\n\n\n"
    assert rows[2] == "\n## Entities: Not provided\n\n\n## Relationships\n```csv\nsource\ttarget\tdescription\nA\tB\tties\n```\n\n## Sources: Not provided\n"


def test_truncation_stays_in_budget(spark):
    lines = [(1, p, i, "y" * (10 + i)) for p in range(3) for i in range(16)]
    df = spark.createDataFrame(lines, "query_id long, part int, rank int, line string")
    row = context.truncate_context(df, (128, 128, 512)).first()
    shown = [x for x in row["context"].split("\n") if x.startswith("y")]
    assert sum(len(x) + 1 for x in shown) <= 128 + 128 + 512 + 16
    assert (row["n_entities"], row["n_relations"]) >= (1, 1)
    assert "Not provided" in context.truncate_context(df.where("part = 2"), (128, 128, 512)).first()["context"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["abc", "déf ", ".", "\n\n", "!", "w" * 30, "。"]), max_size=60).map("".join), st.integers(10, 40), st.integers(0, 9))
def test_chunks_rebuild_the_text(body, size, overlap):
    plain_chunks = chunking.split_text(body, size, 0)
    assert "".join(plain_chunks) == body
    chunks = chunking.split_text(body, size, overlap)
    assert len(body) > size or chunks == [body]
    for before, after in zip(chunks, chunks[1:]):
        assert any(before.endswith(after[:n]) for n in range(overlap + 1)) or not before


@pytest.mark.parametrize("text, want", [
    ("aaaa.bbbb.cccc", ["aaaa.", ".bbbb.", ".cccc"]),  # 5 + 4 leave less than 4 of 10 free
    ("aaaaaaaaa.bb.cc", ["aaaaaaaaa.", ".bb.cc"]),  # the first piece has all of the room
    ("aa.bb.cc.dd", ["aa.bb.", ".bb.cc.dd"]),
    ("aaaaaaaaaaaa.b", ["", "aaaaaaaaaaaa.", ".b"]),
    ("0123456789", ["0123456789"]),
])
def test_chunks_by_hand(text, want):
    """Size 10, overlap 4, worked out on paper."""
    assert chunking.split_text(text, 10, 4) == want


def test_chunk_oversize_first_piece():
    assert chunking.split_text("x" * 50 + ".y", 20, 5)[0] == ""


def test_chunk_ids(spark):
    docs = spark.createDataFrame([(1, "test data"), (2, "test data"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["id"] for r in chunking.chunks_of(docs).collect()}
    assert rows[1] == rows[2] == xxhash.xxh3_64_intdigest(b"test data") // 2 and set(rows) == {1, 2, 4}


def test_pagerank_paths_agree(spark):
    rng = np.random.default_rng(0)
    edges = [(i, f"n{a}", f"n{b}") for i, (a, b) in enumerate(rng.integers(0, 12, (30, 2)).tolist())]
    relations = spark.createDataFrame(edges, "edge_id long, source string, target string")
    seeds = spark.createDataFrame([(1, "n1", 1.0), (1, "n2", 3.0), (2, "alone", 1.0), (2, "n3", 1.0)], "query_id long, name string, weight double")
    local = {(r["query_id"], r["idx"]): r["score"] for r in graph.personalized_pagerank(relations, seeds, 10).collect()}
    joined = {(r["query_id"], r["idx"]): r["score"] for r in graph.personalized_pagerank(relations, seeds, 10, local_edges=0).collect() if r["score"]}
    assert local == pytest.approx(joined)
    for q in (1, 2):
        assert sum(v for (k, _), v in local.items() if k == q) == pytest.approx(1)
    # a dense solution of the same rounds
    names = sorted({n for _, a, b in edges for n in (a, b)} | {"alone"})
    m = np.zeros((len(names),) * 2)
    for _, a, b in edges:
        m[names.index(a), names.index(b)] += 1
        m[names.index(b), names.index(a)] += 1
    degree = m.sum(axis=1, keepdims=True)
    t = np.divide(m, degree, where=degree > 0, out=np.zeros_like(m))
    r = np.zeros(len(names))
    r[names.index("alone")] = r[names.index("n3")] = 0.5
    p = r
    for _ in range(10):
        p = 0.85 * (p @ t) + (1 - 0.85 * p[degree[:, 0] > 0].sum()) * r
    assert {n: v for n, v in zip(names, p) if v} == pytest.approx({k: v for (q, k), v in local.items() if q == 2})


def test_knn_scores(spark):
    vec = lambda a: [float(np.cos(a)), float(np.sin(a))]
    store = spark.createDataFrame([(i, vec(np.arccos(c))) for i, c in enumerate([1, 0.8, 0.6, -1])] + [(9, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, vec(0))], "query_id long, embedding array<float>")
    found = [(r["id"], round(r["score"], 5)) for r in vector.knn(asked, store, 3).orderBy("rank").collect()]
    assert found == [(0, 1.0), (1, 0.9), (2, 0.8)]
    assert vector.knn(asked, store, 9).count() == 4 and vector.knn(asked, store.limit(0), 2).count() == 0
    assert [r["idx"] for r in vector.score_all(asked, store, 4, 0.85).orderBy("idx").collect()] == [0, 1]


def test_merge_entities(spark):
    new = spark.createDataFrame([(2, "A", "Y", "second"), (1, "A", "X", "first"), (3, "B", "Z", "long " * 200)], "ord long, name string, type string, description string")
    stored = spark.createDataFrame([("A", "Y", "old"), ("C", "Q", "unseen")], "name string, type string, description string")
    rows = {r["name"]: r for r in merge.merge_entities(new, stored).collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["description"] == "first\nsecond\nold" and rows["A"]["type"] == "Y"
    assert rows["B"]["oversize"] and not rows["A"]["oversize"]
    alone = {r["name"]: r["type"] for r in merge.merge_entities(new).collect()}
    assert alone["A"] == "X"  # of equals the first to arrive
    assert {r["name"]: r["description"][:6] for r in merge.last_wins(new).collect()} == {"A": "second", "B": "long l"}


def test_apply_groups_in_order():
    edges = [{"edge_id": i, "description": f"d{i}", "chunks": [i]} for i in range(5)]
    out = merge.apply_groups(edges, [([1, 2, 0], "m"), ([4, 3, 99], "n"), ([2], "ignored")])
    assert [(e["edge_id"], e["description"], e["chunks"]) for e in out] == [(1, "m", [0, 1, 2]), (4, "n", [3, 4])]
    again = merge.apply_groups(edges, [([0, 1], "a"), ([1, 2], "b")])
    assert [e["edge_id"] for e in again] == [0, 1, 3, 4]


def test_merge_edges_below_threshold(spark):
    schema = "edge_id long, source string, target string, description string, chunks array<long>"
    new = spark.createDataFrame([(i, f"s{i % 3}", f"t{i // 3}", "d", [i]) for i in range(9)], schema)
    none = spark.createDataFrame([], schema)
    assert merge.merge_edges(new, none).count() == 9
    assert merge.merge_edges(new, new.withColumn("edge_id", F.col("edge_id") + 100), threshold=1).count() == 9


def test_valid_edges(spark):
    names = spark.createDataFrame([("source1",), ("target1",)], "name string")
    edges = spark.createDataFrame([("source1", "target1"), ("source1", "target2"), (None, "target1")], "source string, target string")
    assert [tuple(r) for r in merge.valid_edges(edges, names).collect()] == [("source1", "target1")]


def test_kv(spark):
    store = spark.createDataFrame([("a", 0, "x"), ("b", 3, "y")], "key string, idx long, value string")
    new = spark.createDataFrame([(1, "b", "z"), (2, "c", "u"), (3, "d", "v"), (4, "e", "w"), (5, "c", "u2")], "ord long, key string, value string")
    rows = {r["key"]: (r["idx"], r["value"]) for r in kv.upsert(store, new).collect()}
    assert rows == {"a": (0, "x"), "b": (3, "z"), "c": (2, "u2"), "d": (1, "v"), "e": (4, "w")}
    first = kv.upsert(store.limit(0), new)
    assert sorted(r["idx"] for r in first.collect()) == [0, 1, 2, 3]
    keys = spark.createDataFrame([(0, "nope"), (1, "a")], "pos long, key string")
    assert [r["idx"] for r in kv.lookup(keys, store).orderBy("pos").collect()] == [None, 0]
    assert [r["key"] for r in kv.delete(store, keys).collect()] == ["b"]


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    rows = order.with_position(df, F.col("x")).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1000)) and [r["x"] for r in rows] == sorted(r["x"] for r in rows)
    assert order.with_position(df.limit(0), F.col("x")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Sample\tname", "a\nb", 0.9, "Über_uns, 3 x!")], "name string, d string, s double, t string")
    row = df.select(text.tsv_row(F.col("name"), F.col("d"), F.col("s")).alias("tsv"), text.reference_item(F.lit(1), F.col("name")).alias("ref"), text.token_count(F.col("t")).alias("n"), text.entity_type(F.col("name"), ["sample_name"]).alias("k"), text.prompt("{{x}} {name}", name=F.col("s")).alias("p")).first()
    assert row["tsv"] == "Sample name\ta  b\t0.9" and row["ref"] == "[1]  Sample\tname\n=====\n\n" and row["n"] == 5 and row["k"] == "UNKNOWN" and row["p"] == "{x} 0.9"


def test_base64_round_trip(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    rows = df.select("v", vectors.to_base64("v").alias("b")).withColumn("back", vectors.from_base64("b")).collect()
    assert rows[0]["back"] == [1.0, -2.5] and rows[1]["b"] is None
    assert np.frombuffer(base64.b64decode(rows[0]["b"]), np.float32).tolist() == [1.0, -2.5]


def test_citations():
    chunks = [(10, '{"meta":"b"}', "one"), (11, '{"meta":"a"}', "two"), (12, '{"meta":"b"}', "three"), (13, None, "four")]
    answer, docs = context.cite("x[1][4]. y [3] z [9] w[2, ].", chunks)
    assert answer == "x[1: 1][2: 1]. y [1: 2] z  w[2, ]."
    assert docs[1] == {"meta": {"meta": "b"}, "chunks": {1: "one", 2: "three"}} and docs[2]["meta"] == {}


def test_upsert_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    new = spark.createDataFrame([(1, 2, [3.0, 4.0]), (2, 2, [0.0, 2.0]), (3, 5, [2.0, 0.0])], "ord long, id long, embedding array<double>")
    rows = {r["id"]: (r["change"], r["embedding"]) for r in vector.upsert(store, new, "ord").collect()}
    assert rows == {1: ("keep", [1.0, 0.0]), 2: ("update", [0.0, 1.0]), 5: ("insert", [1.0, 0.0])}
