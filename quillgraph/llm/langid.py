"""Language of whole texts by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes. Filters of several widths slide over a window, each keeps its highest
response, and a softmax layer turns these into probabilities; a text's are the mean of its windows', by bytes.
The network is trained in numpy on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textbytes import chunks, mapped, _LOWER

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The network is fitted on about so many labelled texts at most, as many of each language as may be, and on so many
#: windows of each, spread over the whole text; of longer texts, only on windows of LEAST_BYTES bytes or more.
SAMPLE_TEXTS, WINDOWS_PER_TEXT, LEAST_BYTES = 3000, 3, 32
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 300, 64, 0.01
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts (A-Z in lower case, the last of each filled up with 0), the text of each, and its bytes. An empty text has one."""
    size = np.diff(offsets)
    count = np.maximum(-(-size // WINDOW), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], size)] = _LOWER[data]
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - first[owner]
    return out.reshape(-1, WINDOW), owner, np.minimum(size[owner] - place * WINDOW, WINDOW)


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # of each width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def prepare(self) -> None:
        """Tables of what pairs of bytes add to each filter of width 2, to the first two of 3, and to both halves of 4."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        self.tables = [[pair(f[i], f[i + 1]) if i + 1 < len(f) else f[i].astype(np.float32) for i in range(0, len(f), 2)] for f in self.filters]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each window."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for f, tables in zip(self.filters, self.tables):
            n = WINDOW - len(f) + 1
            total = np.take(tables[0], pairs[:, :n], axis=0)
            for i, table in enumerate(tables[1:], 1):
                total += np.take(table, pairs[:, 2 * i : 2 * i + n] if len(table) > 256 else x[:, 2 * i : 2 * i + n], axis=0)
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self.pooled(x[i : i + 64]) for i in range(0, len(x), 64)]) if len(x) else np.zeros((0, len(self.bias)), np.float32)
        return _softmax(np.maximum(hidden + self.bias, 0) @ self.dense + self.offset)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """x: windows, y: the number of each one's language. Classes weigh alike. Adam on the cross entropy; only the best place of each filter gets a gradient."""
    rng = np.random.default_rng(seed)
    net = Network(languages, [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages)))
    params = [*net.filters, net.bias, net.dense, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(languages)), 1) / len(languages))[y]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(x), 1)))):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            step += 1
            xb, k = x[part], np.arange(len(part))
            best, place = [], []
            for f in net.filters:
                n = WINDOW - len(f) + 1
                response = sum(np.take(f[i], xb[:, i : i + n], axis=0) for i in range(len(f)))
                at = response.argmax(axis=1)
                place.append(at)
                best.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
            hidden = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
            error = _softmax(hidden @ net.dense + net.offset)
            error[k, y[part]] -= 1
            error *= weight[part][:, None] / len(part)
            back = (error @ net.dense.T) * (hidden > 0)
            grads = []
            for j, f in enumerate(net.filters):
                g = np.zeros_like(f)
                own = back[:, j * FILTERS : (j + 1) * FILTERS]
                for i in range(len(f)):
                    np.add.at(g[i], (xb[k[:, None], place[j] + i], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            for p, g, (m, v) in zip(params, [*grads, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)], moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their classes, and the languages: from texts whose lang is known and that aren't held out, chosen by a hash of the id in an equal number for each language (all, of a rare one)."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = SAMPLE_TEXTS / len(languages)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, share / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000

    def cut(batches):
        for batch, data, offsets in chunks(batches, "text"):
            x, owner, size = windows_of(data, offsets)
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            take = np.unique(np.concatenate([np.linspace(a, b - 1, WINDOWS_PER_TEXT).astype(np.int64) for a, b in zip(first[:-1], first[1:])])) if batch.num_rows else first[:0]
            alone = np.diff(first)[owner[take]] == 1
            take = take[(size[take] >= LEAST_BYTES) | (alone & (size[take] > 0))]  # not the short rest of a longer text
            text = pa.array(owner[take])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(text), batch.column("lang").take(text), pa.array([w.tobytes() for w in x[take]], pa.binary())], names=["doc_id", "lang", "bytes"])

    rows = known.where(draw < limit).select("doc_id", "lang", "text").transform(mapped, cut, "doc_id long, lang string, bytes binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["bytes"])))
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return x, np.array([languages.index(r["lang"]) for r in rows], np.int64), languages


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score for each row. Null text, text without a letter (Unicode category L), or no network: und, 0. Of languages with equal probabilities, the first in code-point order. Equal texts get equal values. Other columns are dropped."""
    if net is not None:
        net.prepare()

    def run(batches):
        for batch, data, offsets in chunks(batches, "text"):
            n = batch.num_rows
            letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            some = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~some).tolist():
                some[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            name, score = np.array(["und"] * n, object), np.zeros(n)
            if net is not None and n:
                x, owner, size = windows_of(data, offsets)
                p = np.zeros((n, len(net.languages)))
                np.add.at(p, owner, net.probabilities(x) * size[:, None])
                p /= np.maximum(np.diff(offsets), 1)[:, None]
                best = p.argmax(axis=1)
                name[some] = np.array(net.languages, object)[best[some]]
                score[some] = np.clip(p[np.arange(n), best], 0, 1)[some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").transform(mapped, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on docs' own labelled texts that aren't held out, and predict all of docs. No rows: no rows."""
    x, y, languages = sample(docs)
    return predict(docs, train(x, y, languages) if len(x) else None)


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
