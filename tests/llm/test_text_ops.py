"""BPE, language ID, quality, HTML, media: against the library, held-out accuracy, round trips and fixtures."""

import hashlib
import html
import io
import random
import re
import struct
import tarfile
import zlib

import duckdb
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bpe, html_text, langid, media, quality, queries
from quillgraph.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "<|endoftext|>x", "é" * 3000, "I'm 12  \x00\x1c\x85\xa0 你好🙂", "word " * 4000]


def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(ODD)] + [(1, "", "en", "s", None), (None, "text of nobody", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_librarys(library):
    random.seed(5)
    letters = list("abcdeiou  \n\t'sStre019<|>endoftext!?.-=é你🙂\x1c\xa0ß\r")
    texts = ["".join(random.choices(letters, k=random.randint(0, 70))) for _ in range(1500)] + [t or "" for t in ODD]
    texts += ["".join(chr(random.randint(1, 0x2FFF)) for _ in range(40)) for _ in range(300)] + ["=-" * 700, "x" * 3000]
    codec = bpe.codec(bpe.default_vocabulary())
    for text, got, want in zip(texts, codec.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got[0] == ",".join(map(str, want.ids)) and got[1] == len(want.ids)
        assert got[2].decode() == library.decode(want.ids, skip_special_tokens=False) == codec.decode(want.ids)


def test_greedy_and_merged_blocks_agree_with_plain_loops():
    codec = bpe.codec(bpe.default_vocabulary())
    random.seed(2)
    words = [bytes(random.choices(b" thenriaso", k=random.randint(1, 30))) for _ in range(500)]
    assert codec.encode_words(words) == [codec.merged(w) for w in words]


def test_op8(spark, library):
    rows = {r["doc_id"]: r for r in bpe.digests(odd_docs(spark).select("doc_id", "text", F.lit(1).alias("n_tokens"), F.lit(2).alias("a.b"))).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and rows[i]["a.b"] == 2
    back = bpe.decode(bpe.encode(odd_docs(spark))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(ODD) + 2
    assert bpe.digests(odd_docs(spark).limit(0)).count() == 0


def test_op5(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (langid.crc_of(r["doc_id"]) % 4 == 2) for r in got)


def test_language_of_odd_texts(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, f"the cat number{i} sat", "en", None, None) for i in range(20)] + [(200 + i, f"der hund nummer{i} saß", "de", None, None) for i in range(20)], DOCS))
    rows = langid.identify(docs).collect()
    by_text = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == docs.count() and all(by_text[i]["lang_pred"] == "und" and by_text[i]["score"] == 0 for i in (0, 1, 2))
    assert by_text[101]["lang_pred"] == "en" and by_text[201]["lang_pred"] == "de" and by_text[5]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_letters_are_of_category_l(spark):
    """Numbers that are no letters (½, ², ①) are und; letters of any script are not, and extra columns of any name do no harm."""
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(["½ ² ①", "12 _", "你好", "ʰ", "words of a text", "words of a text", "ª"])], DOCS)
    rows = {r["doc_id"]: r for r in langid.identify(docs.withColumns({"lang_pred": F.lit(1), "score": F.lit(2), "held_out": F.lit(3), "bytes": F.lit(4)})).collect()}
    assert [rows[i]["lang_pred"] == "und" for i in range(7)] == [True, True, False, False, False, False, False]
    assert rows[4]["score"] == rows[5]["score"]


def test_network_against_plain_loops():
    """Responses, pooling, softmax and the mean over windows, byte by byte."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    texts = [b"the cat sat on the mat " * 20, b"der hund und die katze " * 30, b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, owner, size = langid.windows_of(data, offsets)
    net = langid.train(x, np.array([0, 0, 1, 1, 1, 0])[: len(x)], ["de", "en"])
    net.bias, net.offset = rng.normal(0, 0.2, net.bias.shape), rng.normal(0, 0.2, net.offset.shape)
    net.prepare()
    got = net.probabilities(x)
    for w, p in zip(x.tolist(), got):
        hidden = []
        for f in net.filters:
            for j in range(f.shape[2]):
                hidden.append(max(sum(float(f[i, w[at + i], j]) for i in range(len(f))) for at in range(len(w) - len(f) + 1)))
        hidden = [max(h + b, 0) for h, b in zip(hidden, net.bias.tolist())]
        z = [sum(h * d for h, d in zip(hidden, net.dense[:, k].tolist())) + net.offset[k] for k in range(2)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(p, [v / sum(e) for v in e], atol=1e-5)


def test_windows_cover_whole_texts():
    import numpy as np

    data = np.frombuffer(b"A" * 700 + b"b" * 256, np.uint8)
    x, owner, size = langid.windows_of(data, np.array([0, 700, 700, 956]))
    assert owner.tolist() == [0, 0, 0, 1, 2] and size.tolist() == [256, 256, 188, 0, 256] and x[0, 0] == ord("a") and x[2, 188] == 0


def test_op2(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 1000
    good, bad = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1], [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_sparse_sites_are_shrunk(spark):
    """A large host of bad documents moves its members; a host of one document does not move it."""
    text = lambda i, good: f"plain words stand here number {i} and go on." if good else f"Junk%%% {i}### words*** $$$ !!! %%%"
    rows = [(i, text(i, i % 10 > 0), "en", "good.example", None) for i in range(300)] + [(1000 + i, text(i, i % 10 == 0), "en", "bad.example", None) for i in range(300)] + [(5000, text(7, True), "en", "lonely.example", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("text").startswith("plain"), 1).otherwise(0).alias("quality"))
    found = {r["doc_id"]: r for r in quality.score(spark, docs, labels).collect()}
    assert found[1]["host_p"] > 0.8 and found[1001]["host_p"] < 0.2 and 0.35 < found[5000]["host_p"] < 0.65
    assert found[1]["posterior"] > found[5000]["posterior"] > found[1000]["posterior"]


def test_posteriors_by_hand(spark):
    """Levels of hosts and folders, their strengths and the posterior, from the text's own probabilities in plain loops."""
    import math
    from collections import defaultdict

    rng = random.Random(4)
    text = lambda i, good: f"plain words stand here number {i} and go on for a while." if good else f"Junk%%% {i}### words*** $$$ !!! %%%"
    sites = ["https://U@Good.example:80/blog/a", "http://good.example/shop/b?x", "http://good.example/c", "bad.example", None, "", "http://bad.example/blog/z"]
    rows = [(i, None if i == 9 else text(i, rng.random() < (0.2 if "bad" in (sites[i % 7] or "") else 0.8)), "en", sites[i % 7], None) for i in range(200)]
    rows += [rows[3], (None, text(1, True), None, "bad.example", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"host": F.lit(1), "path": F.lit(2), "p": F.lit(3), "logit": F.lit(4), "keep": F.lit(5)})
    labels = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("text").startswith("plain"), 1).otherwise(0).alias("quality"), F.lit(1).alias("text"))
    got = quality.score(spark, docs, labels).collect()
    assert len(got) == len(rows)
    place = {sites[0]: ("good.example", "blog"), sites[1]: ("good.example", "shop"), sites[2]: ("good.example", None), sites[3]: ("bad.example", None), None: (None, None), "": ("", None), sites[6]: ("bad.example", "blog")}
    site = {r[0]: place[r[3]] for r in rows}
    hosts, folders = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[site[r["doc_id"]][0]].append(r["text_p"])
        if site[r["doc_id"]][1]:
            folders[site[r["doc_id"]]].append(r["text_p"])
    every = [r["text_p"] for r in got]
    mean = sum(every) / len(every)

    def strength(groups):
        n, k = sum(map(len, groups)), len(groups)
        noise = sum(sum((p - sum(g) / len(g)) ** 2 for p in g) for g in groups) / (n - k)
        spread = (sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups) - (k - 1) * noise) / (n - sum(len(g) ** 2 for g in groups) / n)
        return min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread > 1e-9 else 1e6

    k_host, k_path = strength(list(hosts.values())), strength(list(folders.values()))
    odds = lambda p: math.log(p / (1 - p))
    for r in got:
        host, folder = site[r["doc_id"]]
        own = r["text_p"]
        host_p = (k_host * mean + sum(hosts[host]) - own) / (k_host + len(hosts[host]) - 1)
        path_p = (k_path * host_p + sum(folders[host, folder]) - own) / (k_path + len(folders[host, folder]) - 1) if folder else host_p
        assert r["host_p"] == pytest.approx(min(max(host_p, 1e-4), 1 - 1e-4), rel=1e-6) and r["path_p"] == pytest.approx(min(max(path_p, 1e-4), 1 - 1e-4), rel=1e-6)
        assert odds(min(max(r["posterior"], 1e-12), 1 - 1e-12)) == pytest.approx(odds(own) + odds(r["path_p"]) - odds(mean), rel=1e-4, abs=1e-4)
    cut = min(r["posterior"] for r in got if r["keep"])
    assert all(r["keep"] == (r["posterior"] >= cut) for r in got)  # equal ones alike
    known = docs.select("doc_id", "text", "source", "lang", "n_chars").where("doc_id = 3")
    assert len({r["posterior"] for r in quality.score(spark, known, labels).collect()}) == 1


def test_encoding_is_bounded_in_memory(spark, monkeypatch):
    """Texts are encoded in pieces of bounded bytes, all of them in order, and a worker keeps no vocabulary when its task ends."""
    import pyarrow as pa

    runs, sizes = [], []
    monkeypatch.setattr(bpe, "mapped", lambda df, run, schema: runs.append(run) or df)
    encode = bpe.Codec.encode_texts
    monkeypatch.setattr(bpe.Codec, "encode_texts", lambda self, texts: sizes.append([len(t) for t in texts]) or encode(self, texts))
    bpe.digests(spark.createDataFrame([(1, "")], "doc_id long, text string"))
    texts = ["word " * (i * 40) for i in range(100)] + [None, "long " * 100_000, None, "", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], names=["c1", "c0"])
    out = pa.Table.from_batches(list(runs[0](iter([batch, batch.slice(0, 0)]))))
    assert out["doc_id"].to_pylist() == list(range(len(texts))) and [n for x in sizes for n in x] == [len(t or "") for t in texts]
    assert len(sizes) > 3 and all(sum(x) <= 1 << 18 or len(x) == 1 for x in sizes)
    assert bpe.codec.cache_info().currsize == 0
    codec = bpe.codec(bpe.default_vocabulary())
    assert out["n_tokens"].to_pylist() == [codec.encode_texts([t or ""])[0][1] for t in texts]


def test_quality_is_fitted_on_every_label(spark):
    """Model and threshold of 20 000 labelled documents, against numpy on all of them at once."""
    import numpy as np

    rng = random.Random(8)
    words = lambda n, junk: " ".join(rng.choice(["%%%", "Buy!!", "###", "win$"]) if rng.random() < junk else rng.choice(["plain", "words", "stand", "here"]) for _ in range(n))
    y = np.array([rng.random() < 0.7 for _ in range(20_000)], float)
    texts = [words(rng.randint(4, 12), 0.15 if good else 0.35) for good in y]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(spark, docs, labels).collect()}
    raw = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    z = np.concatenate([np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-4), -8, 8), np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    p = 1 / (1 + np.exp(-z @ w))
    assert max(abs(got[i]["text_p"] - p[i]) for i in range(len(p))) < 2e-3
    good = sorted(got[i]["posterior"] for i in range(len(y)) if y[i])
    cut = good[int(len(good) * quality.LOST_GOOD)]
    assert 0 < cut < 0.5 and good[0] < cut and all(r["keep"] == (r["posterior"] >= cut) for r in got.values())


def test_value_of_a_rank(spark, monkeypatch):
    monkeypatch.setattr(quality, "PICKED", 3)
    monkeypatch.setattr(quality, "PARTS", 4)
    values = [0.5] * 9 + [0.1, 0.1, 0.2, 1e-9, 0.9, 0.90000001, 1.0, 0.3]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality._of_rank(table, i) for i in range(len(values))] == sorted(values)


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(3, 1), (3, None), (4, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    docs = odd_docs(spark)
    assert quality.score(spark, docs, labels).count() == docs.count()
    assert all(r["keep"] for r in quality.score(spark, docs, labels.limit(0)).collect())
    assert quality.keep_good(spark, docs, labels.limit(0)).columns == docs.columns and quality.keep_good(spark, docs.limit(0), labels).count() == 0


def test_op9(spark):
    rows = {r["page_id"]: r for r in queries.op9_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert rows[page["page_id"]]["text"] == want and rows[page["page_id"]]["n_chars"] == len(want) and rows[page["page_id"]]["url"] == page["url"]


PAGE = """<html><body><div class="page"><header><h1>Site</h1></header><div id="menu"><a href=x>menu</a></div><div class="cookie-notice">We use</div>
<div class="post-{n} entry"><header><h1>T &lt; a</h1></header><p>First para &amp;amp; text. <b>bold</b> <a href=1>link</a><br>more<p>Second<ul><li>one<li>two</ul>
<div class="ad">buy</div><script>var a="</div>";</script>{extra}</div><div id="comments"><p>A reader says something here. And more of it, much more than the text.</p></div><aside>s</aside><form>f</form></div><footer>c</footer>"""


@pytest.mark.parametrize("source, want", [
    ("<section></section><div><a href=x>menu link only</a></div>", "menu link only"),
    ("<div><div><div><a href=x>one</a> <a href=y>two</a></div></div></div>", "one two"),
    ("<article><p>Long text that stays here, of some length.</p><p class='side-note'>A side note.</p><div class='related-work'><p>Other work.</p></div><div class='related-posts'>gone</div><p class=advert>gone</p><ol class='comment-list'><li>gone</ol><div class='share'>gone</div></article>", "Long text that stays here, of some length.\nA side note.\nOther work."),
    ("<article><p>The formula <math><mi>x</mi></math> holds.</p></article>", "The formula x holds."),
    ("<article><p><![CDATA[&amp;lt; b]]></p></article>", "&lt; b"),
    ("<p></p><div></div>", ""),
])
def test_pages_by_hand(source, want):
    page = html_text.Page(source)
    assert page.text(page.path()) == page.text("no such path") == page.text(None) == want


def test_deep_pages_and_repeated_rows(spark):
    """Elements in one another by thousands, many containers of one path, and rows that repeat."""
    deep = "<div>" * 5000 + "<p>Deep text that is long enough to be read.</p>" + "</div>" * 5000
    body = "<body><article>" + "<div class=part><p>A paragraph of the text, one of many.</p></div>" * 300 + "</article></body>"
    pages = [(1, "http://a.example/", deep), (1, "http://a.example/", deep), (2, "http://b.example/", body), (None, None, body)]
    rows = html_text.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit(2), "_host": F.lit(3)})).collect()
    assert sorted((r["page_id"] or 0, r["text"].count("\n"), r["n_chars"]) for r in rows) == [(0, 299, 300 * 38 - 1), (1, 0, 41), (1, 0, 41), (2, 299, 300 * 38 - 1)]


def test_html_votes_by_host(spark):
    pages = [(i, "http://U@Blog.example:80/a", PAGE.replace("{n}", str(i)).replace("{extra}", "")) for i in range(5)]
    # this page's comment-like block is larger than its article, but its host has decided
    odd = PAGE.replace("{n}", "77").replace("{extra}", "").replace("<aside>", "<div class='other'><p>" + "A long, long tail of something else. " * 30 + "</p></div><aside>")
    pages += [(10, "https://blog.example/b?x", odd), (11, None, odd), (12, "https://blog.example/c", None), (13, "nonsense", ""), (14, "https://blog.example/d", "no markup &eacute;"), (15, "https://else.example/", "<p>" + "x " * 50000)]
    rows = {r["page_id"]: r["text"] for r in html_text.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect()}
    want = "T < a\nFirst para &amp; text. bold link more\nSecond\none\ntwo"
    assert all(rows[i] == want for i in range(5)) and rows[10] == want and "long tail" in rows[11]
    assert rows[12] == rows[13] == "" and rows[14] == "no markup é" and len(rows[15]) == 99999
    assert html_text.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("long", ["<body class='{}'>".format(" ".join(f"utility-{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))), "<div class=wrapper>" * 60])
def test_long_paths_stay_apart(spark, long):
    """Containers below a long list of classes or deep nesting are told from one another."""
    page = long + "<div class=top><p>A few words of the site's own that are shown.</p></div><article><p>{}</p></article><div class=more><p>More words, on something else entirely.</p></div>"
    pages = [(i, f"https://long.example/{i}", page.format(f"The text of page {i}. " * 20)) for i in range(3)]
    rows = {r["page_id"]: r["text"] for r in html_text.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {i: (f"The text of page {i}. " * 20).strip() for i in range(3)}
    assert all(len(p) <= html_text.MOST_PATH for p in html_text.Page(pages[0][2]).paths)


BODY = "<p>" + "The body of the text, of many words. " * 80 + "</p>"
LEAD = "<p>" + "The lead of the text. " * 20 + "</p>"


@pytest.mark.parametrize("page", [
    "<article>{lead}<div class=content>{body}</div></article>",
    "<article><header><h1>Head</h1><div class=standfirst>{lead}</div></header><div><div><div class=content>{body}</div></div></div><section><p>End.</p></section></article>",
    "<main><h1>Head</h1>{lead}<div class=content>{body}</div></main>",
    "<div class=post><h1>Head</h1>{lead}<div class=inner>{body}</div></div><div class=side-notes><p>A note on something else, in a column.</p></div>",
    "<div class=wrap><h1>Head</h1>{lead}<div class=entry-content>{body}</div></div><div class=blog-notes><p>A note on something else, in a column.</p></div>",
    "<div class=wrap><div><h1>Head</h1>{lead}<div class=inner>{body}</div></div></div><div class=blog-notes><p>A note on something else, in a column.</p></div>",
])
def test_article_beside_its_content_container(spark, page):
    """What stands in the article beside its largest container stays; what stands beside the article goes."""
    source = "<body><nav>menu</nav>" + page.format(lead=LEAD, body=BODY) + "<div class=others><a href=1>Another text of this site</a> <a href=2>And one more of these</a></div></body>"
    rows = html_text.extract(spark, spark.createDataFrame([(i, u, source) for i, u in enumerate(["https://a.example/1", None])], "page_id long, url string, html string")).collect()
    want = [*(["Head"] if "Head" in page else []), LEAD[3:-4].strip(), BODY[3:-4].strip(), *(["End."] if "End." in page else [])]
    assert [r["text"] for r in rows] == ["\n".join(want)] * 2


def test_lead_that_most_pages_of_a_host_lack(spark):
    pages = [(i, f"https://b.example/{i}", f"<body><div class=wrap>{LEAD if i == 3 else ''}<div class=inner>{BODY}</div></div>") for i in range(4)]
    rows = {r["page_id"]: r["text"] for r in html_text.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[0] == rows[1] == rows[2] == BODY[3:-4].strip() and rows[3] == LEAD[3:-4].strip() + "\n" + rows[0]


def test_op7(spark):
    docs = odd_docs(spark)
    rows = media.media_table(spark, docs.withColumn("digest", F.lit("x"))).collect()
    assert len(rows) == docs.count()
    texts = {i: (t or "").encode() for i, t in enumerate(ODD)} | {None: b"text of nobody"}
    by_text = {}
    for r in rows:
        payload = texts[r["doc_id"]] + bytes(-len(texts[r["doc_id"]]) % 64 if texts[r["doc_id"]] else 64)
        assert r["n_bytes"] == len(texts[r["doc_id"]]) and r["payload_bytes"] == len(payload) == r["width"] * r["height"]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        png = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and media.from_png(png) == payload
        assert by_text.setdefault(payload, r["feature"]) == r["feature"]
        assert r["feature"] == f"n={len(payload)};sum={sum(payload)};distinct={len(set(payload))};changes={sum(a != b for a, b in zip(payload, payload[1:]))}"
        body = b"".join(b"\x00" + payload[k : k + 64] for k in range(0, len(payload), 64))  # the stored form, part by part
        at, parts = 8, {}
        while at < len(png):
            (n,) = struct.unpack(">I", png[at : at + 4])
            parts[png[at + 4 : at + 8]], at = png[at + 8 : at + 8 + n], at + 12 + n
        assert zlib.decompress(parts[b"IDAT"]) == body and struct.unpack(">IIBBBBB", parts[b"IHDR"]) == (64, len(payload) // 64, 8, 0, 0, 0, 0)
    assert media.media_table(spark, docs.limit(0)).count() == 0


def test_shards_are_tar_files(spark):
    scratch = Scratch(spark, "tar")
    folder = scratch.folder("shards")
    catalog = scratch.table(media.store(odd_docs(spark), folder))
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    for r in media.places(catalog).collect():
        with fs.open_input_file(f"{path}/{r['shard']}") as f:
            whole = f.read()
        member = next(m for m in tarfile.open(fileobj=io.BytesIO(whole)).getmembers() if m.name == f"{bytes(r['digest']).hex()}.png")
        assert (member.offset_data, member.size) == (r["at"], r["length"])
        assert whole[r["at"] :][:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">I", whole[r["at"] + 16 : r["at"] + 20])[0] == 64


def test_sql_of_the_package(spark):
    from tests.oracle import connect, same

    con = connect(SF)
    for name, sql in queries.SQL.items():
        same(queries.QUERIES[name](spark, SF), con, sql)


def test_names():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and duckdb
