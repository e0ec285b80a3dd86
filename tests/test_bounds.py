"""What a task holds, and what reaches the driver, doesn't grow with the input."""

import re

import pyarrow as pa

from quillgraph.functions.batches import OUT_LETTERS, OUT_ROWS, PIECE_BYTES, packed, pieces
from quillgraph.operators import chunking, graph, merge
from quillgraph.plans import services
from quillgraph.sources.scratch import Scratch


class Frame:
    """Stands for a DataFrame: run is the function that its tasks would run."""

    sparkSession = conf = property(lambda self: self)
    columns, schema = ["doc_id", "text"], None

    def get(self, *_):
        return "1000"

    def select(self, *_):
        return self

    where = unionByName = select

    def transform(self, f, *rest):
        return f(self, *rest)

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_mentions_leave_in_batches_of_bounded_size():
    text = " x ".join(f"Name{i}" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(12)), "id": list(range(12)), "pos": pa.array([0] * 12, pa.int32()), "content": [text] * 12})
    out = list(services.extract(Frame(), services.RuleExtractor()).run(iter([batch])))
    assert max(b.num_rows for b in out) <= OUT_ROWS and max(b.nbytes for b in out) <= 2 * OUT_LETTERS
    entities, relations = services.RuleExtractor().subgraph(text)
    want = [("entity", *e) for e in entities] + [("relation", *r) for r in relations]
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(d, d, 0, i, *row, None) for d in range(12) for i, row in enumerate(want)]


def test_pieces_and_packs():
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "é", "b" * 20, "", "c" * 9, "cc"]})
    assert [p.column("t").to_pylist() for p in pieces([batch, batch.slice(0, 0)], "t", 10)] == [["aaaa", None, "é"], ["b" * 20], ["", "c" * 9], ["cc"]]
    assert [b.num_rows for b in packed([(1, "aaaa"), (2, None), (3, "b" * 20), (4, "c")], ["n", "t"], [pa.int64(), pa.string()], 2, 10)] == [2, 1, 1]
    assert list(packed([], ["n"], [pa.int64()])) == []


def test_texts_are_cut_a_few_at_a_time(spark):
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"{i}. " + "A sentence of seven words stands here. " * 4000 for i in range(40)]})
    out = list(chunking.chunk(Frame()).run(iter([whole])))
    assert max(b.nbytes for b in out) <= 2 * PIECE_BYTES
    want = [(i, k, c) for i, t in enumerate(whole.column("text").to_pylist()) for k, c in enumerate(chunking.split_text(t))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_rounds_of_pagerank_broadcast_neither_masses_nor_links(spark, monkeypatch):
    plans, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df))
    relations = spark.createDataFrame([(i, f"E{i}", f"E{i * 7 % 20}", "", []) for i in range(40)], "edge_id long, source string, target string, description string, chunks array<long>")
    seeds = spark.createDataFrame([(1, "E3", 1.0), (2, "E5", 2.0)], "query_id long, name string, weight double")
    graph.personalized_pagerank(relations, seeds, 3, local_edges=0)
    joins = [j for p in plans for j in re.findall(r"(\w+Join) \[idx#\d+\], \[u#\d+\]", p)]
    assert joins == ["SortMergeJoin"] * 3


def test_edges_of_one_description_merge_without_python(spark):
    kind = "edge_id long, source string, target string, description string, chunks array<long>"
    stored = [(i, f"A{i % 3}", "B", [None, "x", "y"][i % 4 % 3], None if i % 5 == 0 else [i, i % 2, i]) for i in range(14)]
    new = [(i // 2, f"A{i % 4}", None if i % 7 == 0 else "B", ["x", "y", "z", None][i % 9 % 4], [i, 3, 3]) for i in range(16)] + [(5, "A1", "B", "x", [9]), (5, "A1", "B", "x", [9]), (90, "C", "D", "alone", [7, 7, 1]), *[(91 + i, "C", "D", "both", None) for i in range(5)]]
    quiet = [(200 + i, "Q", "R", "x", [i]) for i in range(9)]
    new, stored = spark.createDataFrame(new, kind), spark.createDataFrame(stored + quiet, kind)
    for threshold in (1, 5):
        out = merge.merge_edges(new, stored, threshold=threshold)
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
        in_python = merge.merge_edges(new, stored, lambda d: merge.same_description(d), threshold)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, in_python.select(out.columns).collect()))
        assert out.where("source = 'Q'").count() == 9
