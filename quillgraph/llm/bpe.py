"""Byte-level BPE by speculation and verification.

A word is first cut by greedy longest match. The cut is the true encoding if every two neighbouring tokens are
compatible, i.e. merging the two by rank never crosses the border between them; this is tested for all neighbours
of all new words of a batch in numpy. Words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType
from quillgraph.llm.textbytes import chunks, mapped

CACHED_WORDS = 150_000
#: Texts are encoded together up to about so many bytes (one text at least): all their words are held at once.
BYTES_AT_ONCE = 1 << 18
#: Words of at most so many bytes are encoded together.
SHORT = 32
_NONE = np.int64(1 << 40)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible letter."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A vocabulary in the tokenizers library's JSON form, with encode and decode as that library does them without special tokens added.

    Inside, a token's number is its rank: 0-255 the single bytes, 256 + i what the i-th merge makes.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters, vocab = byte_letters(), model["vocab"]
        singles = sorted(letters, key=vocab.__getitem__)
        rank = {s: i for i, s in enumerate(singles)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        for i, (a, b) in enumerate(merges):
            if a + b in rank:
                raise ValueError(f"two merges make {a + b!r}")
            rank[a + b] = 256 + i
        n = 256 + len(merges)
        self.left, self.right = np.arange(n), np.arange(n)
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i] = rank[a], rank[b]
        made = np.arange(256, n)
        keys = self.left[made] * n + self.right[made]
        order = np.argsort(keys)
        self.keys, self.made, self.n = keys[order], made[order], n
        self.pairs = dict(zip(keys.tolist(), made.tolist()))
        self.bytes = [bytes(letters[c] for c in s) for s in rank]
        self.ids = np.array([vocab[s] for s in rank])
        self.rank_of_id = {int(i): r for r, i in enumerate(self.ids)}
        self.single = [0] * 256
        for s in singles:
            self.single[letters[s]] = rank[s]
        alone = np.ones(n, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], made)
        for t in range(256, n):  # parts come before what they make
            alone[t] &= alone[self.left[t]] and alone[self.right[t]]
        self.known = {self.bytes[t]: t for t in range(n) if alone[t]}
        self.longest: dict[bytes, int] = {}
        for b in self.known:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self._plant()
        self.id_text = [str(i) for i in self.ids.tolist()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions are not supported")
        self.special_bytes = {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def _plant(self) -> None:
        """The trie of all known tokens, as a sorted table of (node, byte) and the node that follows."""
        step: dict[int, int] = {}
        token = [-1]
        for word, t in self.known.items():
            node = 0
            for b in word:
                key = node * 256 + b
                if key not in step:
                    step[key] = len(token)
                    token.append(-1)
                node = step[key]
            token[node] = t
        keys, after = np.array(list(step)), np.array(list(step.values()))
        order = np.argsort(keys)
        self.trie_keys, self.trie_next, self.trie_token = keys[order], after[order], np.array(token)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would no merge of a rank below the limit cross their border, at any state of the merging of either?"""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NONE) if limit is None else limit.astype(np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            key = a * self.n + b
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[where] == key) & (self.made[where] < limit)
            ok[at[crossed]] = False
            # undo the later merge of the two; a single byte cannot be undone
            later_a = a > b
            undo_a, undo_b = self.right[a], self.left[b]
            by_a = (later_a & (undo_a != a)) | (~later_a & (undo_b == b))
            done = (undo_a == a) & (undo_b == b)
            limit = np.where(by_a, a, b + 1)
            a, b = np.where(by_a, undo_a, a), np.where(by_a, b, undo_b)
            go = ~crossed & ~done
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, known, longest = [], 0, len(word), self.known, self.longest
        while i < n:
            size = min(longest.get(word[i : i + 2], 1), n - i)
            while size > 1 and word[i : i + size] not in known:
                size -= 1
            out.append(known[word[i : i + size]] if size > 1 else self.single[word[i]])
            i += size
        return out

    def greedy_block(self, block: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """greedy() of many short words, one byte of each in a step: token matrix and how many tokens each row has."""
        n, width = block.shape
        block = np.concatenate([block, np.zeros((n, 1), block.dtype)], axis=1).astype(np.int64)
        tokens, count = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
        row = np.arange(n)
        at, node, best, best_end = (np.zeros(n, np.int64) for _ in range(4))
        while len(row):
            go = at < size[row]
            key = node * 256 + block[row, at]
            where = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            go &= self.trie_keys[where] == key
            node = np.where(go, self.trie_next[where], 0)
            at = at + go
            token = np.where(go, self.trie_token[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            stop = np.flatnonzero(~go)
            tokens[row[stop], count[row[stop]]] = best[stop]
            count[row[stop]] += 1
            at[stop] = best_end[stop]
            left = go | (at < size[row])
            row, at, node, best, best_end = row[left], at[left], node[left], best[left], best_end[left]
        return tokens, count

    def merged_block(self, block: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many short words, one merge of each in a step."""
        n, width = block.shape
        tokens, count = np.array(self.single)[block], size.copy()
        column, row = np.arange(width), np.arange(n)
        best = np.full((n, width), _NONE)
        if width > 1:
            best[:, :-1] = np.where(column[:-1] < count[:, None] - 1, self._merge(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1), _NONE)
        work, ranks = tokens.copy(), best
        while len(row):
            i = np.argmin(ranks, axis=1)
            k = np.arange(len(row))
            made = ranks[k, i]
            go = made < _NONE
            tokens[row[~go]] = work[~go]
            row, work, ranks, i, made = row[go], work[go], ranks[go], i[go], made[go]
            if not len(row):
                break
            k = np.arange(len(row))
            count[row] -= 1
            take = np.minimum(column + (column > i[:, None]), width - 1)
            work, ranks = np.take_along_axis(work, take, 1), np.take_along_axis(ranks, take, 1)
            work[k, i] = made
            ranks[k, i] = _NONE
            ranks[:, -1] = _NONE
            right = np.flatnonzero(i < count[row] - 1)
            ranks[right, i[right]] = self._merge(made[right], work[right, i[right] + 1])
            left = np.flatnonzero(i > 0)
            ranks[left, i[left] - 1] = self._merge(work[left, i[left] - 1], made[left])
        return tokens, count

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[where] == key, self.made[where], _NONE)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals first, with a heap and a linked list."""
        token, n, pairs, base = [self.single[b] for b in word], len(word), self.pairs, self.n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := pairs.get(token[i] * base + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or pairs.get(token[i] * base + token[j]) != made:
                continue
            token[i], token[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := pairs.get(made * base + token[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := pairs.get(token[h] * base + made)) is not None:
                heapq.heappush(heap, (m, h))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ranks of each word's tokens."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > SHORT).tolist():
            cut = self.greedy(words[i])
            flat = np.array(cut)
            out[i] = cut if self.compatible(flat[:-1], flat[1:]).all() else self.merged(words[i])
        short = np.flatnonzero(size <= SHORT)
        if not len(short):
            return out
        width = int(size[short].max(initial=1)) or 1
        block = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in short.tolist()]), np.uint8).reshape(len(short), width)
        tokens, count = self.greedy_block(block, size[short])
        inner = np.arange(1, width) < count[:, None]
        pair, back = np.unique((tokens[:, :-1] * self.n + tokens[:, 1:])[inner], return_inverse=True)
        crossed = np.zeros(inner.shape, bool)
        crossed[inner] = ~self.compatible(pair // self.n, pair % self.n)[back]
        fails = np.flatnonzero(crossed.any(axis=1))
        if len(fails):
            tokens[fails], count[fails] = self.merged_block(block[fails], size[short][fails])
        for i, row, n in zip(short.tolist(), tokens.tolist(), count.tolist()):
            out[i] = row[:n]
        return out

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: their ids as text, how many, and the bytes that these ids stand for."""
        new = list(words.difference(self.cache))
        text, stands = self.id_text, self.bytes
        for word, ranks in zip(new, self.encode_words([w.encode("utf-8", "replace") for w in new])):
            self.cache[word] = (",".join([text[r] for r in ranks]), len(ranks), b"".join([stands[r] for r in ranks]))

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens' strings, and those strings."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text: its ids joined by commas, how many they are, and the bytes of the decoded text."""
        cut = [[(p, True) if special else (self.words.findall(p), False) for p, special in self.parts(t)] for t in texts]
        words: set[str] = set()
        for parts in cut:
            for p, special in parts:
                if not special:
                    words.update(p)
        if len(self.cache) + len(words) > CACHED_WORDS:
            self.cache.clear()
        self.learn(words)
        out, cache = [], self.cache
        for parts in cut:
            found = []
            for p, special in parts:
                found += [(str(self.special[p]), 1, p.encode())] if special else [cache[w] for w in p]
            decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace").encode()
            out.append((",".join([f[0] for f in found]), sum([f[1] for f in found]), decoded))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids of no token are left out."""
        ranks, special = self.rank_of_id, self.special_bytes
        return b"".join([self.bytes[ranks[i]] if i in ranks else special.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """docs with an array column of token ids for its whole text. Null text: as the empty text, no ids. Other columns are kept; a column of the new name is replaced."""
    return _map(docs, text, {ids: pa.list_(pa.int32())}, f"{ids} array<int>", lambda f: [np.array(f[0].split(","), np.int32) if f[1] else np.zeros(0, np.int32)], vocabulary)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with a column of the text that the ids stand for. Null ids: empty text."""
    path = vocabulary or default_vocabulary()
    rest = [c for c in df.columns if c != text]
    schema = StructType([*[df.schema[c] for c in rest], StructField(text, StringType())])
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}

    def run(batches):
        c = codec(path)
        try:
            for batch in batches:
                texts = [c.decode(x or []) for x in batch.column(place[ids]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(place[k]) for k in rest], pa.array(texts, pa.string())], names=[*rest, text])
        finally:
            codec.cache_clear()

    return df.toDF(*place.values()).transform(mapped, run, schema)


def digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and decoded_sha256 of each whole text, for each row of docs.

    Null text: as the empty one, of 0 tokens. Rows of equal text get equal values. Columns of docs with the names of new
    ones give way to them; all others are kept, whatever their names. No rows: no rows.
    """
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _map(docs, text, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda f: [f[1], hashlib.sha256(f[0].encode()).hexdigest(), hashlib.sha256(f[2]).hexdigest()], vocabulary, False)


def _map(docs: DataFrame, text: str, columns: dict[str, pa.DataType], added: str, row, vocabulary: str | None, keep_text: bool = True) -> DataFrame:
    path = vocabulary or default_vocabulary()
    rest = [c for c in docs.columns if c not in columns and (keep_text or c != text)]
    rest = [text] * (text in rest) + [c for c in rest if c != text]
    schema = StructType([*[docs.schema[c] for c in rest], *StructType.fromDDL(added).fields])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # mapInArrow takes no names with dots
    used = dict.fromkeys([place[text], *[place[c] for c in rest]])

    def run(batches):
        c = codec(path)
        try:
            for batch, _, _ in chunks(batches, place[text], BYTES_AT_ONCE):
                found = [row(f) for f in c.encode_texts([t or "" for t in batch.column(place[text]).to_pylist()])]
                new = [pa.array(list(x), kind) for x, kind in zip(zip(*found), columns.values())]
                yield pa.RecordBatch.from_arrays([*[batch.column(place[k]) for k in rest], *new], names=[*rest, *columns])
        finally:
            codec.cache_clear()  # idle workers live on beside those of other stages; it is built again in less than a second

    return docs.toDF(*place.values()).select(*used).transform(mapped, run, schema)
