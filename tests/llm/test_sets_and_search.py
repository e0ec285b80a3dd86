"""Near-duplicates, passages, paragraphs, mixing, top-k and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bpe, components, minhash, mixing, near_dedup, paragraphs, quality, suffix_dedup, textbytes, topk
from quillgraph.sources.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i if first is not None else None, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts, first or 0)], DOCS)


def shingle_set(text, n):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts: dict, n: int):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def edited(words, times, rng):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """A text and many copies with 0 to 12 edits, chains of copies of copies, short texts, others."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = [edited(base, i % 13, rng) for i in range(90)] + [" ".join(base).upper()] * 3
    chain = [f"c{i}" for i in range(120)]
    for _ in range(12):
        chain = edited(chain, 3, rng).split()
        texts.append(" ".join(chain))
    texts += ["a b", "A  B", "a", "", None, " \n", "a b c d", "a b c d e"] + [" ".join(f"x{rng.randrange(9999)}" for _ in range(60)) for _ in range(30)] + ["word " * 3000]
    return texts


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, copies, n):
    docs = docs_of(spark, copies).withColumn("id", F.lit(1)).withColumn("keys", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs, n).collect()}
    assert got == brute_components(dict(enumerate(copies)), n)


def test_near_duplicates_of_odd_rows(spark):
    docs = docs_of(spark, ["same text here", "same text here"]).unionAll(docs_of(spark, ["same text here"])).unionAll(docs_of(spark, ["same text here", None], None))
    rows = near_dedup.near_duplicates(spark, docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [(0, 0, True), (0, 0, True), (1, 0, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    kept = near_dedup.keep_one(spark, docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, -1] or kept.where("doc_id = 0").count() == 1
    assert kept.columns == docs.columns and near_dedup.near_duplicates(spark, docs.limit(0)).count() == 0


def test_prefixes_lose_no_pair(spark):
    """All pairs of similar sets meet, whatever the sizes, when each set is a part of its own."""
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(3, 60), replace=False), rng.integers(1, 2**62, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(80)]
    df = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, part long, elements binary")
    pairs = {(r["a"], r["b"]) for r in minhash._prefix_pairs(Scratch(spark, "t"), df, 80, 100).collect()}
    for i, j in itertools.combinations(range(80), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
            assert (i, j) in pairs


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = np.sort(x[:360]), np.sort(x[40:])
    s = minhash.signatures(np.repeat([0, 1], 360), np.concatenate([a, b]), 2, 256)
    assert abs((s[0] == s[1]).mean() - 320 / 400) < 0.1
    few = minhash.signatures(np.array([0, 0]), x[:2], 2, 64)
    assert (few[0] < np.iinfo(np.uint64).max).all() and (few[1] == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("most", [components.LOCAL_EDGES, 0])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", most)
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up if find(x) != x}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\x0b", max_size=30), min_size=1, max_size=6), st.integers(1, 4))
def test_words_and_shingles(texts, n):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, hashes = textbytes.words(data, offsets, True)
    text = textbytes.text_of(starts, offsets)
    whole = "".join(texts).encode()
    assert [(t, whole[s:e]) for t, s, e in zip(text, starts, ends)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    owner, found = textbytes.shingles(hashes, text, n)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingle_set(t, n)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=40), min_size=1, max_size=6), st.integers(1, 12))
def test_words_in_pieces(texts, size):
    """Pieces of any size give the words of the whole."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = textbytes.words(data, offsets, True)
    old, textbytes.SEGMENT_BYTES = textbytes.SEGMENT_BYTES, size
    try:
        parts = textbytes.words(data, offsets, True)
    finally:
        textbytes.SEGMENT_BYTES = old
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts))


def test_a_text_of_many_megabytes(spark):
    """Longer than any piece: the same words and passages as anywhere else."""
    rng = random.Random(9)
    run = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    long = "filler words of the long text " * 200_000 + run + " x" * 1000
    rows = suffix_dedup.repeated_passages(spark, docs_of(spark, [long, f"start {run} end"])).collect()
    assert {(r["doc_id"], r["n_words"], r["first_doc_id"]) for r in rows} == {(0, 60, 0), (1, 60, 0)}
    got = {r["doc_id"]: r["n_shingles"] for r in near_dedup.near_duplicates(spark, docs_of(spark, [long, run]), 4).collect()}
    assert got[0] == len(shingle_set(long, 4)) and got[1] == 57


def passages_of(texts: dict):
    """For each document the letters in runs of 50 words that other documents share: all, and those that a smaller document has."""
    words = {i: [(m.start(), m.end(), m[0]) for m in WORD.finditer(t or "")] for i, t in texts.items()}
    holders: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(x[2] for x in w[k : k + 50]), set()).add(i)
    shared, gone = set(), set()
    for i, w in words.items():
        for k in range(len(w) - 49):
            s = holders[tuple(x[2] for x in w[k : k + 50])]
            if len(s) > 1:
                letters = {(i, x) for x in range(w[k][0], w[k + 49][1])}
                shared |= letters
                gone |= letters if min(s) < i else set()
    return shared, gone


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"wé{rng.randrange(10**6)}" for _ in range(n))
    long, short, edge = fresh(80), fresh(49), fresh(50)
    texts = [fresh(100), f"{fresh(20)} {long} {fresh(30)}", f"{long}\n{fresh(10)}", f"{fresh(60)} {short}", f"{short} {fresh(60)}", f"{fresh(5)}\n{edge} {fresh(5)}", f"{edge}", long, long, None, "", "a b", fresh(3) + " " + long[: len(long) // 2] + " " + edge]
    return [*texts, "again " * 200, f"{fresh(40)} {'again ' * 60}"]


def test_repeated_passages(spark, passages):
    rows = suffix_dedup.repeated_passages(spark, docs_of(spark, passages)).collect()
    shared, gone = passages_of(dict(enumerate(passages)))
    letters = lambda some: {(r["doc_id"], x) for r in some for x in range(r["begin"], r["end"])}
    assert letters(rows) == shared and letters([r for r in rows if r["removed"]]) == gone
    assert all(r["first_doc_id"] < r["doc_id"] for r in rows if r["removed"])
    assert suffix_dedup.repeated_passages(spark, docs_of(spark, [None, "x"]).limit(0)).count() == 0


@pytest.mark.parametrize("most", [minhash.BROADCAST_IDS, 0])
def test_cut_passages(spark, passages, most, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
    docs = docs_of(spark, passages).withColumns({"spans": F.lit(1), "id": F.lit(2), "row": F.lit(3)}).unionAll(docs_of(spark, [passages[1]], None).withColumns({"spans": F.lit(1), "id": F.lit(2), "row": F.lit(3)}))
    got = {r["doc_id"]: r for r in suffix_dedup.cut_passages(spark, docs).collect()}
    _, gone = passages_of(dict(enumerate(passages)))
    for i, t in enumerate(passages):
        want = None if t is None else "".join(c for k, c in enumerate(t) if (i, k) not in gone)
        if t and WORD.search(t) and not WORD.search(want):
            assert i not in got
        else:
            assert got[i]["text"] == want and got[i]["spans"] == 1
            assert got[i]["n_chars"] == (None if t is None else len(want))
    assert got[None]["text"] == passages[1]


def test_minimisers_are_shared():
    rng = np.random.default_rng(4)
    run = rng.integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64), run, rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)]) for _ in range(2))
        found = [set(suffix_dedup.minimisers(x, np.zeros(len(x), np.int64))[1].tolist()) for x in (a, b)]
        assert found[0] & found[1]


def brute_lines(texts: dict):
    """Every line with a word that another line is alike to, by comparing all pairs: (doc_id, word, begin, end) with the first of its component."""
    lines = []
    for i, t in texts.items():
        at = word = 0
        for line in (t or "").split("\n"):
            if found := list(WORD.finditer(line)):
                lines.append(((i, word, at + found[0].start(), at + found[-1].end()), shingle_set(line, 5)))
                word += len(found)
            at += len(line) + 1
    up = list(range(len(lines)))
    find = lambda x: x if up[x] == x else find(up[x])
    for x, y in itertools.combinations(range(len(lines)), 2):
        a, b = lines[x][1], lines[y][1]
        if 100 * len(a & b) >= 80 * len(a | b):
            p, q = find(x), find(y)
            up[max(p, q)] = min(p, q)
    many = [find(x) for x in range(len(lines))]
    return {lines[x][0]: lines[r][0][:2] for x, r in enumerate(many) if many.count(r) > 1}


@pytest.mark.parametrize("most", [minhash.BROADCAST_IDS, 0])
def test_repeated_lines(spark, most, monkeypatch):
    """Near, equal, short and inner repeats, chains of near copies, lines of repeated words, against all pairs of lines."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
    monkeypatch.setattr(paragraphs, "BROADCAST_LINES", most)
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = [fresh(70).split(), fresh(45).split(), fresh(25).split()]
    pool = [edited(b, rng.randrange(4), rng) for b in base for _ in range(25)] + ["All rights reserved."] * 5 + ["all  rights RESERVED.", "a a a a a a", "a a a a a a a", "x", "own line", "own line", "é è"]
    pool += [fresh(rng.randrange(1, 30)) for _ in range(30)]
    chain = base[1]
    for _ in range(6):
        chain = edited(chain, 1, rng).split()
        pool.append(" ".join(chain))
    rng.shuffle(pool)
    texts: list = ["\n".join(pool[k : k + 4]) + "\n" * (k % 3) for k in range(0, len(pool), 4)] + [None, "", " \n ", "The same\nthe Same"]
    docs = docs_of(spark, texts).withColumns({"word": F.lit(1), "digest": F.lit("x"), "id": F.lit(2), "key": F.lit(3)}).unionAll(docs_of(spark, ["All rights reserved."], None).withColumns({"word": F.lit(1), "digest": F.lit("x"), "id": F.lit(2), "key": F.lit(3)}))
    rows = paragraphs.repeated_lines(spark, docs).collect()
    got = {(r["doc_id"], r["word"], r["begin"], r["end"]): (r["first_doc_id"], r["first_word"]) for r in rows}
    assert len(got) == len(rows) and got == brute_lines(dict(enumerate(texts)))
    assert len({r["component_id"] for r in rows}) == len(set(got.values()))
    twice = docs_of(spark, texts[:3]).unionAll(docs_of(spark, texts[:3]))
    assert {r["doc_id"] for r in paragraphs.repeated_lines(spark, twice).collect()} == {0, 1, 2}
    assert paragraphs.repeated_lines(spark, docs.limit(0)).count() == 0 and paragraphs.find_repeats(spark, docs.limit(0)).count() == 0


def test_banding_of_lines_finds_nine_of_ten():
    """Recall of the bands alone over pairs of lines of a similarity of 0.8 and little more."""
    rng = np.random.default_rng(5)
    found = total = 0
    for _ in range(300):
        x = np.unique(rng.integers(1, 2**62, 54).astype(np.uint64))
        a, b = np.sort(x[:48]), np.sort(np.concatenate([x[:43], x[48:53]]))  # 43 of 53
        keys = minhash.band_keys(minhash.signatures(np.repeat([0, 1], 48), np.concatenate([a, b]), 2, paragraphs.BANDS * paragraphs.ROWS), paragraphs.ROWS)
        found, total = found + bool((keys[0] == keys[1]).any()), total + 1
    assert found >= 0.97 * total


def test_runs_inside_lines_are_found(spark):
    """Passages of 50 words or more in the middle of a line, of one or two sentences or without stops, are in a row, whole."""
    rng = random.Random(16)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, edge, less, across = fresh(51), f"{fresh(25)}. {fresh(26)}", fresh(50), fresh(49), f"{fresh(30)}\n{fresh(30)}"
    texts = [f"{fresh(9)} {one} {fresh(9)}", f"{fresh(30)} {one.upper()} {fresh(7)}", f"{fresh(5)} {two} {fresh(5)}. {fresh(9)}", f"{fresh(8)} {two} {fresh(8)}", f"{fresh(8)} {edge} {fresh(3)}", f"{fresh(2)} {edge} {fresh(4)}"]
    texts += [f"{fresh(8)} {less} {fresh(3)}", f"{fresh(2)} {less} {fresh(4)}", f"{fresh(3)} {across} {fresh(3)}", f"{fresh(4)} {across} {fresh(5)}"]
    rows = paragraphs.find_repeats(spark, docs_of(spark, texts)).where("n_words >= 50 AND component_id IS NULL").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(got) == 8 and all(got[i]["removed"] == (i % 2 == 1) and got[i]["first_doc_id"] == i - i % 2 for i in got)
    want = dict(zip([0, 2, 4, 8], [one, two, edge, across])) | dict(zip([1, 3, 5, 9], [one.upper(), two, edge, across]))
    assert {i: texts[i][r["begin"] : r["end"]] for i, r in got.items()} == want
    cut = {r["doc_id"]: r["text"] for r in paragraphs.cut_paragraphs(spark, docs_of(spark, texts)).collect()}
    assert all(cut[i] == (texts[i].replace(want[i], "") if i in want and i % 2 else texts[i]) for i in range(10))


def test_short_paragraphs_have_rows(spark):
    """Every line that repeats is told, with its component, whatever its length; shorter ones are not cut."""
    rng = random.Random(26)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long = fresh(30)
    near = " ".join([*long.split()[:-1], "other"])
    texts = [f"{fresh(9)}\n{long}\nAll rights reserved.", f"All rights Reserved.\n{fresh(9)}\nown line\nown line", f"{near}\n{fresh(8)}\nAll rights reserved.\nAll rights reserved.", "own words", None, ""]
    rows = paragraphs.find_repeats(spark, docs_of(spark, texts)).collect()
    got = sorted((r["doc_id"], texts[r["doc_id"]][r["begin"] : r["end"]], r["n_words"], r["first_doc_id"], r["first"]) for r in rows)
    assert got == [(0, "All rights reserved.", 3, 0, True), (0, long, 30, 0, True), (1, "All rights Reserved.", 3, 0, False), (1, "own line", 2, 1, False), (1, "own line", 2, 1, True)] + [(2, "All rights reserved.", 3, 0, False)] * 2 + [(2, near, 30, 0, False)]
    assert len({r["component_id"] for r in rows if r["n_words"] == 3}) == 1 and len({r["component_id"] for r in rows}) == 3 and not any(r["removed"] or r["passage"] for r in rows)
    assert {r["doc_id"]: r["text"] for r in paragraphs.cut_paragraphs(spark, docs_of(spark, texts)).collect()} == dict(enumerate(texts))


def brute_targets(sizes: dict):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in sizes if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else "w " * rng.randrange(1, 40), "en", rng.choice(["a", "b", "B", "é", "c", None] + ["big"] * 4), None) for i in range(3000)] + [(9999, "", "en", "empty", None), (None, "some words", None, "a", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(spark, docs).collect()
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    taken: dict = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(0.12 * target[s], 60) for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(spark, docs.repartition(5)).collect()))
    emitted = mixing.mix(spark, docs.withColumn("copies", F.lit(7)))
    assert emitted.columns == [*docs.columns, "copies"] and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.plan(spark, docs.limit(0)).count() == 0 and mixing.mix(spark, docs.limit(0)).count() == 0


def test_mixing_stays_in_the_jvm(spark):
    plan = mixing.plan(spark, docs_of(spark, ["a b", "c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 16, 20, 64]), st.integers(1, 60), st.sampled_from([2, 300, 2**30, 2**40]))
def test_search_is_exact(seed, d, n, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, d))
    x[rng.integers(0, n, n // 3)] = x[0]
    ids = rng.permutation(10 * n)[:n]
    exact = lambda a, b: sum(int(u) * int(v) for u, v in zip(a, b))
    if spread == 2**40:
        x[:, 1:] >>= 24  # within 64 bits only if one component is large in few rows
        x[1:, 0] >>= 22
    assume(max(abs(exact(a, b)) for a in x for b in x) < 2**63)  # else an error; see below
    for (got, score), q, own in zip(topk.search(x, ids, x, ids, 5), x, ids):
        want = sorted(((-exact(c, q), int(i)) for c, i in zip(x, ids) if i != own))[:5]
        assert [(-int(v), int(ids[i])) for i, v in zip(got, score)] == want


def test_scores_beyond_64_bits_are_an_error():
    x = np.array([[2**62, 1], [4, 1], [2, 3]])
    assert topk.search(x[1:], np.array([1, 2]), x[1:], np.array([1, 2]), 5)[0][1].tolist() == [11]
    with pytest.raises(OverflowError):
        topk.search(x[:1], np.array([0]), x, np.arange(3), 5)


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, [float("nan"), 1.0]), (200, [2.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5]), (4, []), (None, [9.0, 9.0]), (2, [1.0, 2.0]), (5, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit(1), "v": F.lit(2), "c": F.lit(3), "score": F.lit(4)})
    got = [tuple(r) for r in topk.nearest(vectors).orderBy("query_id", "rank").collect()]
    best = {0: [(1, 5 * 65536), (2, 5 * 65536), (2, 5 * 65536), (200, 4 * 65536), (3, 32768)], 200: [(0, 4 * 65536), (1, 4 * 65536), (2, 4 * 65536), (2, 4 * 65536), (3, 65536)]}
    assert got == [(q, i + 1, v, s) for q, found in best.items() for i, (v, s) in enumerate(found)]
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_of_repeated_queries(spark):
    """Each row of an id is a query, and a candidate of the other one."""
    rows = [(50, [1.0]), (50, [2.0]), (1, [1.0])]
    got = sorted(tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(50, 1, 1, 131072), (50, 1, 50, 131072), (50, 2, 1, 65536), (50, 2, 50, 131072)]


def test_mixing_of_many_sources(spark, monkeypatch):
    """Each document its own source, in ranges and without a broadcast; rows without an id draw by their text."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(40), "en", f"s{rng.randrange(10**6)}", None) for i in range(400)] + [(None, f"word{i} " * 5, "en", "none", None) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    got = mixing.plan(spark, docs).collect()
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got) and len(got) == 800
    mine = [r["copies"] for r in got if r["source"] == "none"]
    rate = target["none"] / sizes["none"]
    assert rate == int(rate) or len(set(mine)) == 2 and abs(sum(mine) / len(mine) - rate) < 0.1


def test_pipeline(spark, tmp_path):
    """run() against the stages done by hand on collected rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    keep = {r["doc_id"] for r in quality.score(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in keep}
    rows = {i: rows[i] for i, (_, _, kept) in brute_components({i: r["text"] for i, r in rows.items()}, 5).items() if kept}
    texts = {i: r["text"] for i, r in rows.items()}
    _, gone = passages_of(texts)
    texts = {i: "".join(c for k, c in enumerate(t) if (i, k) not in gone) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if WORD.search(t)}
    mixed = mixing.plan(spark, spark.createDataFrame([(i, t, rows[i]["source"]) for i, t in texts.items()], "doc_id long, text string, source string")).collect()
    codec = bpe.codec(bpe.default_vocabulary())
    import hashlib

    want = []
    for r in mixed:
        ids, n, decoded = codec.encode_texts([texts[r["doc_id"]]])[0]
        want += [(r["doc_id"], r["source"], n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())] * r["copies"]
    assert got == sorted(want) and len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_good_documents_by_every_label(spark, tmp_path):
    """The quality stage judges by all labels: its cut is the exact rank among all 9000 good documents."""
    rng = random.Random(5)
    words = lambda junk: " ".join(rng.choice(["%%%", "Buy!!", "###", "win$"]) if rng.random() < junk else rng.choice(["plain", "words", "stand", "here"]) for _ in range(rng.randint(4, 12)))
    docs = docs_of(spark, [words(0.15 if i % 4 else 0.35) for i in range(12_000)])
    labels = docs.selectExpr("doc_id", "if(doc_id % 4 = 0, 0, 1) AS quality")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()}
    scored = quality.score(spark, docs, labels).collect()
    cut = sorted(r["posterior"] for r in scored if r["doc_id"] % 4)[int(9000 * quality.LOST_GOOD)]
    assert cut < 0.5 and kept == {r["doc_id"] for r in scored if r["posterior"] >= cut}


def test_pipeline_counts_labels_of_null_texts(spark, tmp_path):
    """The quality stage fits and cuts by labels of null texts too, as of empty ones: of all good documents it loses LOST_GOOD at most."""
    texts = ["plain words " * (20 + i % 30) if i % 4 else "plain win$ " * (1 + i % 3) for i in range(400)]
    nulls = [None if i % 10 == 1 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1 if i % 4 or i % 10 == 1 else 0) for i in range(400)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = [{r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs_of(spark, t), str(tmp_path)).collect()} for t in (nulls, [t or "" for t in nulls])]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert kept[0] == kept[1] and len(good - kept[0]) <= len(good) * quality.LOST_GOOD and len(kept[0]) < 400
    both = docs_of(spark, texts).unionAll(docs_of(spark, [None] * 400))  # a text goes before a null of its id
    a, b = ({(r["doc_id"], r["y"], tuple(r["x"])) for r in quality.labelled(quality._text_features(d, "source"), labels).collect()} for d in (docs_of(spark, texts), both))
    assert a == b


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    docs = docs_of(spark, ["", None, "a b c", "a b c", "x " * 2000]).unionAll(docs_of(spark, ["nobody"], None))
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
            out.collect()
