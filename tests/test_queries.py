import base64
import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillgraph import queries
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_vec_base64(spark):
    want = {r["vec_id"]: np.array(r["embedding"], "<f4").tobytes() for r in table(spark, "embeddings")}
    rows = rows_of(spark, "vec_base64")
    assert len(rows) == len(want) and all(base64.b64decode(r["base64"]) == want[r["vec_id"]] and r["content_id"] == hashlib.md5(want[r["vec_id"]]).hexdigest() for r in rows)


def test_hash_embed(spark):
    want = {r["doc_id"]: Counter(re.findall(r"\w+", (r["text"] or "").lower())) for r in table(spark, "documents")}
    rows = rows_of(spark, "hash_embed")
    assert len(rows) == len(want)
    for r in rows:
        v = [0.0] * 64
        for word, n in want[r["doc_id"]].items():
            h = xxhash.xxh3_64_intdigest(word.encode())
            v[h % 64] += math.log(1 + n) * (1 if h >= 2**63 else -1)
        length = math.sqrt(sum(x * x for x in v)) or 1
        assert r["embedding"] == pytest.approx([x / length for x in v], abs=1e-5)


def test_extract_mentions(spark):
    """Names are runs of words with a capital; what stands in one sentence is tied in a row."""
    chunks = {(d["doc_id"], i): c for d in table(spark, "documents") if d["text"] is not None for i, c in enumerate(brute_chunks(d["text"]))}
    rows = rows_of(spark, "extract_mentions")
    assert {r["kind"] for r in rows} == {"entity", "relation"}
    named = {}
    for r in rows:
        text = " ".join(chunks[r["doc_id"], r["pos"]].upper().split())
        assert " ".join(r["a"].split()) in text and (r["kind"] == "entity" or " ".join(r["b"].split()) in text)
        assert r["kind"] == "relation" or r["b"] == "PHRASE"
        if r["kind"] == "entity":
            assert named.setdefault((r["doc_id"], r["pos"], r["a"]), r["n"]) == r["n"]
    assert all((r["doc_id"], r["pos"], end) in named for r in rows if r["kind"] == "relation" for end in (r["a"], r["b"]))


def test_query_entities(spark):
    texts = {r["item_id"]: r["text"] for r in table(spark, "benchmark")}
    rows = rows_of(spark, "query_entities")
    assert {r["query_id"] for r in rows} == set(texts) and any(r["named"] for r in rows) and any(r["generic"] for r in rows)
    for r in rows:
        assert all(n == n.upper() and n in texts[r["query_id"]].upper() for n in r["named"])
        assert all(len(w) > 4 and w in texts[r["query_id"]].lower() and w not in " ".join(r["named"]).lower().split() for w in r["generic"])


def test_response_json(spark):
    kinds = {(r["query_id"], r["kind"], r["rank"]): (r["key"], r["score"]) for r in rows_of(spark, "context_tables")}
    found = {}
    for r in rows_of(spark, "response_json"):
        body = json.loads(r["json"])
        assert body["response"] == "See [1]."
        for name, kind in (("entities", "entity"), ("relations", "relation"), ("chunks", "chunk")):
            for x in body["context"].get(name) or []:
                key = x.get("name") or (f"{x['source']}>{x['target']}" if "source" in x else str(x["id"]))
                found[r["query_id"], kind, x["rank"]] = (key, round(x["score"], 9))
    assert found.keys() == kinds.keys() and all(found[k][0] == kinds[k][0] and found[k][1] == pytest.approx(kinds[k][1]) for k in found)


def test_truncate_context(spark):
    kinds = Counter((r["query_id"], r["kind"]) for r in rows_of(spark, "context_tables"))
    for r in rows_of(spark, "truncate_context"):
        assert len(r["context"]) <= 64000 + 100 and r["n_entities"] <= kinds[r["query_id"], "entity"]
        assert r["context"].count("\n=====\n") == r["n_chunks"] <= kinds[r["query_id"], "chunk"]
        lines = r["context"].split("\n")
        assert lines[1] == "## Entities" and lines[3] == "name\tdescription" and sum(x.count("\t") == 2 for x in lines) - 1 <= r["n_relations"]


def test_format_references(spark):
    for r in rows_of(spark, "format_references"):
        cited = json.loads(r["references"])
        assert re.fullmatch(r"As (\[\d+: [\d, ]+\])+ and  ?say, (\[\d+: \d+\])?\.", r["response"]) and sorted(map(int, cited)) == list(range(1, len(cited) + 1))
        assert sum(len(d["chunks"]) for d in cited.values()) == min(3, len([x for x in rows_of(spark, "context_tables") if x["query_id"] == r["query_id"] and x["kind"] == "chunk"]))


def test_ann_search(spark):
    exact = queries.QUERIES["knn_cosine"](spark, SF)
    found = queries.QUERIES["ann_search"](spark, SF)
    from quillgraph.operators import ann

    assert ann.recall(found.where("rank <= 5"), exact.where("rank <= 5")) >= 0.9


def test_every_query_is_checked(spark):
    """Each has SQL or a test of its own above or below."""
    own = {"vec_base64", "hash_embed", "extract_mentions", "query_entities", "response_json", "truncate_context", "format_references", "ann_search", "chunk_docs", "chunk_ids"}
    assert set(queries.QUERIES) - set(queries.SQL) == own


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def brute_chunks(text):
    """Letter by letter: pieces and separators, gathered up to 2800 letters (the very first piece up to 3200), after the longest tail of whole pieces of 400 letters at most."""
    pieces, at = [""], 0
    while at < len(text):
        found = next((s for s in ("\n\n\n", "\n\n", "\r\n\r\n", *"。．.！!？?") if text.startswith(s, at)), None)
        pieces[-1:] = [pieces[-1], found, ""] if found else [pieces[-1] + text[at]]
        at += len(found or "x")
    own = [[]]
    for i, piece in enumerate(pieces if len(text) > 3200 else [text]):
        if i % 2 == 0 and len("".join(own[-1])) + len(piece) > (3200 if i == 0 else 2800):
            own.append([])
        own[-1].append(piece)
    tail = lambda before: max((before[len(before) - n :] for n in range(len(before) + 1) if len("".join(before[len(before) - n :])) <= 400), key=len)
    return ["".join(own[0]), *["".join(tail(a) + b) for a, b in zip(own, own[1:])]]


def test_chunks_of_whole_texts(spark):
    """chunk_docs and chunk_ids over the whole table, most of all over texts that are cut."""
    want = {r["doc_id"]: brute_chunks(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()}
    assert sum(len(c) > 2 for c in want.values()) > 10
    got = sorted((r["doc_id"], r["pos"], r["n_chars"], r["md5"]) for r in queries.QUERIES["chunk_docs"](spark, SF).collect())
    assert got == sorted((d, i, len(c), hashlib.md5(c.encode()).hexdigest()) for d, cut in want.items() for i, c in enumerate(cut))
    ids = sorted((r["doc_id"], r["pos"], r["id"]) for r in queries.QUERIES["chunk_ids"](spark, SF).collect())
    assert ids == sorted((d, cut.index(c), xxhash.xxh3_64_intdigest(c.encode()) // 2) for d, cut in want.items() for c in set(cut))
