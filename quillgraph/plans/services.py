"""What the engine asks of models, with deterministic stand-ins that need no network.

Services are sent to tasks with the plan, so they must be picklable; clients are best opened on first use. What they
return is written to a table once, as a task that is run again would ask again. Calls are repeated a few times, and held
back to the rates of Limits, within each task: with n tasks at once, a service sees n times these rates at most.
"""

from __future__ import annotations

import re
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import chain
from threading import Lock
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quillgraph.functions.batches import mapped, packed, pieces
from quillgraph.functions.repair import read_json
from quillgraph.plans import prompts

_NAME = re.compile(r"\b[^\W\d_a-z][\w'-]*(?:\s+[^\W\d_a-z][\w'-]*)*")
_WORD = re.compile(r"\w+")


Mentions = tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]


class Extractor(Protocol):
    def subgraph(self, text: str) -> Mentions:
        """Entities (name, type, description) and relations (source, target, description)."""

    def question(self, text: str) -> tuple[list[str], list[str]]:
        """Named and generic entities."""


class Embedder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Writer(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Summariser(Protocol):
    def shorten(self, description: str, limit: int) -> str: ...


class Chat(Protocol):
    """A conversation with a model: messages are {role, content}, the last one is to be answered."""

    def reply(self, messages: list[dict[str, str]]) -> str | None: ...


class NoResponseError(Exception):
    """A service gave no answer, or none that can be read."""


@dataclass
class Limits:
    """How a task calls a service: attempts at each call, with growing waits in between, and the most calls at once, a second and a minute (None: any)."""

    attempts: int = 3
    first_wait: float = 4.0
    longest_wait: float = 10.0
    at_once: int = 1
    per_second: int | None = None
    per_minute: int | None = None
    batch: int = 128  # texts in a call


class Calls:
    """Calls of one task within its limits."""

    def __init__(self, limits: Limits, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.limits, self.sleep, self.now = limits, sleep, now
        self.lock, self.begun = Lock(), deque()

    def _turn(self) -> None:
        """Waits until a call more is within the rates."""
        while True:
            with self.lock:
                t = self.now()
                while self.begun and self.begun[0] <= t - 60:
                    self.begun.popleft()
                waits = [0.0]
                for most, span in ((self.limits.per_second, 1.0), (self.limits.per_minute, 60.0)):
                    if most and len(self.begun) >= most:
                        waits.append(self.begun[-most] + span - t)
                if max(waits) <= 0:
                    self.begun.append(t)
                    return
            self.sleep(max(waits))

    def one(self, call: Callable[[], Any]) -> Any:
        """What call() returns; after failures, including a None, it is called again. The last failure is raised."""
        wait = self.limits.first_wait
        for left in range(max(self.limits.attempts, 1) - 1, -1, -1):
            self._turn()
            try:
                out = call()
                if out is None:
                    raise NoResponseError("the service gave no answer")
                return out
            except Exception:
                if not left:
                    raise
            self.sleep(min(wait, self.limits.longest_wait))
            wait *= 2

    def each(self, call: Callable[[Any], Any], items: Iterable[Any]) -> Iterator[Any]:
        """call() of each item, in their order, some at once; in place of a result, the exception that one ended with."""

        def safe(item):
            try:
                return self.one(lambda: call(item))
            except Exception as e:  # noqa: BLE001  told to the caller, item by item
                return e

        if self.limits.at_once <= 1:
            yield from map(safe, items)
            return
        with ThreadPoolExecutor(self.limits.at_once) as pool:
            yield from pool.map(safe, items)


def converse(chat: Chat, prompt: str, system: str | None = None, history: list[dict[str, str]] | None = None) -> tuple[Any, list[dict[str, str]]]:
    """The JSON of the model's answer, and all messages with it. NoResponseError, if there is none."""
    text, messages = told(chat, prompt, system, history)
    try:
        return read_json(text), messages
    except ValueError as e:
        raise NoResponseError(f"no JSON in {text[:200]!r}") from e


def told(chat: Chat, prompt: str, system: str | None = None, history: list[dict[str, str]] | None = None) -> tuple[str, list[dict[str, str]]]:
    """The model's answer, and all messages with it."""
    messages = [*([{"role": "system", "content": system}] if system else []), *(history or []), {"role": "user", "content": prompt}]
    text = chat.reply(messages)
    if not text:
        raise NoResponseError("the model gave no answer")
    return text, [*messages, {"role": "assistant", "content": text}]


def _mentions(found: Any) -> Mentions:
    """An extractor's JSON as rows; what lacks a name or an end is left out."""
    found = found if isinstance(found, dict) else {}
    rows = lambda key: [r for r in found.get(key) or [] if isinstance(r, dict)]
    text = lambda r, key: str(r.get(key) or "")
    entities = [(text(r, "name"), text(r, "type"), text(r, "desc")) for r in rows("entities") if r.get("name")]
    edges = [(text(r, "source"), text(r, "target"), text(r, "desc")) for key in ("relationships", "other_relationships") for r in rows(key) if r.get("source") and r.get("target")]
    return entities, edges


@dataclass
class ChatExtractor:
    """Asks a chat model. After the first answer it is asked up to `gleanings` times for what it missed, until it says that nothing is."""

    chat: Chat
    types: list[str]
    domain: str = ""
    examples: list[str] = field(default_factory=list)
    gleanings: int = 0

    def subgraph(self, text: str) -> Mentions:
        system = prompts.EXTRACT_SYSTEM.format(domain=self.domain, examples="; ".join(self.examples), types=prompts.types_text(self.types))
        found, history = converse(self.chat, prompts.EXTRACT.format(text=text), system)
        entities, edges = _mentions(found)
        for i in range(self.gleanings):
            more, history = converse(self.chat, prompts.EXTRACT_MORE, history=history)
            for known, new in zip((entities, edges), _mentions(more)):
                known.extend(new)
            if i + 1 < self.gleanings and str((converse(self.chat, prompts.EXTRACT_DONE, history=history)[0] or {}).get("status")) == "done":
                break
        return entities, edges

    def question(self, text: str) -> tuple[list[str], list[str]]:
        found, _ = converse(self.chat, prompts.QUESTION.format(text=text))
        return tuple([str(x) for x in (found.get(key) if isinstance(found, dict) else None) or []] for key in ("named", "generic"))


@dataclass
class ChatSummariser:
    chat: Chat

    def shorten(self, description: str, limit: int) -> str:
        found, _ = converse(self.chat, prompts.SUMMARY.format(description=description, limit=limit), prompts.SUMMARY_SYSTEM)
        if not isinstance(found, dict) or not found.get("description"):
            raise NoResponseError("no description in the answer")
        return str(found["description"])


@dataclass
class ChatGrouper:
    """For merge.merge_edges(): groups of statements that a model finds alike."""

    chat: Chat
    limits: Limits = field(default_factory=Limits)

    def __call__(self, descriptions: list[str]) -> list[tuple[list[int], str]]:
        listing = "\n".join(f"{i}, {d}" for i, d in enumerate(descriptions))
        found, _ = Calls(self.limits).one(lambda: converse(self.chat, prompts.GROUP.format(listing=listing), prompts.GROUP_SYSTEM))
        groups = (found.get("groups") if isinstance(found, dict) else None) or []
        return [([int(i) for i in g["ids"] if str(i).lstrip("-").isdigit()], str(g.get("description") or "")) for g in groups if isinstance(g, dict) and isinstance(g.get("ids"), list)]


@dataclass
class ChatWriter:
    chat: Chat
    with_references: bool = True

    def answer(self, question: str, context: str) -> str:
        template = prompts.ANSWER_WITH_REFERENCES if self.with_references else prompts.ANSWER
        return told(self.chat, template.format(context=context, question=question))[0]


@dataclass
class AllSentences:
    """The offline summariser: sentences said once, in their order, as many whole ones as fit; the first is cut if it alone does not."""

    def shorten(self, description: str, limit: int) -> str:
        out = ""
        for sentence in dict.fromkeys(s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", description) if s.strip()):
            if len(out) + len(sentence) + bool(out) <= limit:
                out += " " * bool(out) + sentence
        return out or description[:limit]


@dataclass
class RuleExtractor:
    """Capitalised phrases are entities; neighbours in a sentence are related."""

    def subgraph(self, text: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
        entities: dict[str, str] = {}
        relations = []
        for sentence in re.split(r"[.!?\n]+", text):
            names = list(dict.fromkeys(m[0].strip().upper() for m in _NAME.finditer(sentence)))
            said = sentence.strip()  # held once, by all that it is about
            for n in names:
                entities.setdefault(n, said)
            relations += [(a, b, said) for a, b in zip(names, names[1:])]
        return [(n, "PHRASE", d) for n, d in entities.items()], relations

    def question(self, text: str) -> tuple[list[str], list[str]]:
        named = list(dict.fromkeys(m[0].strip().upper() for m in _NAME.finditer(text)))
        inside = {w for n in named for w in n.lower().split()}
        return named, [w for w in dict.fromkeys(_WORD.findall(text.lower())) if len(w) > 4 and w not in inside]


@dataclass
class HashingEmbedder:
    """Words hashed to signed dimensions, weighed by the logarithm of their count, and scaled to length 1."""

    size: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.size), np.float64)
        for row, text in zip(out, texts):
            for word, n in Counter(_WORD.findall(text.lower())).items():
                h = xxhash.xxh3_64_intdigest(word.encode())
                row[h % self.size] += (1 if h >> 63 else -1) * np.log1p(n)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).astype(np.float32)


@dataclass
class QuotingWriter:
    """Answers with the first source."""

    def answer(self, question: str, context: str) -> str:
        return "See [1]." if "[1]" in context else "No answer was found."


def embed(texts: DataFrame, embedder: Embedder, column: str = "text", limits: Limits | None = None) -> DataFrame:
    """texts with a column embedding of embedder.size numbers. A call that fails to the last, or gives vectors of another number or size, ends the job."""
    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    limits = limits or Limits()

    def checked(part: list[str]) -> np.ndarray:
        out = np.asarray(embedder.encode(part), np.float32)
        if out.shape != (len(part), embedder.size):
            raise ValueError(f"{len(part)} texts were asked for in {embedder.size} dimensions, and {out.shape} came")
        return out

    def run(batches):
        calls = Calls(limits)
        for whole in batches:
            parts = [whole.slice(at, limits.batch) for at in range(0, whole.num_rows, limits.batch)]
            for part, vectors in zip(parts, calls.each(checked, ([t or "" for t in p.column(column).to_pylist()] for p in parts))):
                if isinstance(vectors, Exception):
                    raise vectors
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return texts.transform(mapped, run, schema)


_MENTIONS = "doc_id long, chunk_id long, pos int, n int, kind string, a string, b string, description string, error string"


def extract(chunks: DataFrame, extractor: Extractor, limits: Limits | None = None) -> DataFrame:
    """chunks (doc_id, id, pos, content) -> mentions: kind entity (a name, b type), relation (a source, b target), or failed with an error; n: its place in the answer.

    A chunk that fails to the last is one row with its error. All mentions of its document are to be left out; see whole_documents().
    """
    limits = limits or Limits()

    def run(batches):
        calls = Calls(limits)

        def rows(batch):
            keys = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "id", "pos")])
            for key, found in zip(keys, calls.each(extractor.subgraph, batch.column("content").to_pylist())):
                if isinstance(found, Exception):
                    yield *key, 0, "failed", None, None, None, repr(found)
                    continue
                both = chain((("entity", *e) for e in found[0]), (("relation", *r) for r in found[1]))
                for i, (kind, a, b, d) in enumerate(both):
                    yield *key, i, kind, a.upper(), b.upper(), d, None

        names = ["doc_id", "chunk_id", "pos", "n", "kind", "a", "b", "description", "error"]
        for batch in pieces(batches, "content"):
            yield from packed(rows(batch), names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5])

    return chunks.select("doc_id", "id", "pos", "content").transform(mapped, run, _MENTIONS)


def whole_documents(mentions: DataFrame) -> DataFrame:
    """Mentions of documents no chunk of which failed: half a document would not be asked for again."""
    failed = mentions.where("kind = 'failed'").select("doc_id").distinct()
    return mentions.join(failed, "doc_id", "left_anti")


def ask_entities(questions: DataFrame, extractor: Extractor, limits: Limits | None = None) -> DataFrame:
    """questions (query_id, text) with named and generic entities. A call that fails to the last ends the job."""
    limits = limits or Limits()

    def run(batches):
        calls = Calls(limits)
        for batch in pieces(batches, "text"):
            found = list(calls.each(extractor.question, [t or "" for t in batch.column("text").to_pylist()]))
            if bad := next((f for f in found if isinstance(f, Exception)), None):
                raise bad
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("text"), pa.array([[n.upper() for n in f[0]] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=["query_id", "text", "named", "generic"])

    return questions.select("query_id", "text").transform(mapped, run, "query_id long, text string, named array<string>, generic array<string>")


def replaced(rows: DataFrame, column: str, call: Callable[..., str], inputs: list[str], limits: Limits | None = None, failed: str | None = None) -> DataFrame:
    """rows with a text column set to call(*inputs); rows with a null input keep a null. failed: what stands for a call that fails to the last; else it ends the job."""
    limits = limits or Limits()
    rest = [c for c in rows.columns if c != column]
    schema = StructType([*[rows.schema[c] for c in rest], StructField(column, StringType())])

    def run(batches):
        calls = Calls(limits)
        for whole in batches:
            for at in range(0, whole.num_rows, limits.batch):
                batch = whole.slice(at, limits.batch)
                asked = list(zip(*[batch.column(c).to_pylist() for c in inputs]))
                some = [i for i, x in enumerate(asked) if None not in x]
                out: list[str | None] = [None] * len(asked)
                for i, text in zip(some, calls.each(lambda x: call(*x), [asked[i] for i in some])):
                    if isinstance(text, Exception):
                        if failed is None:
                            raise text
                        text = failed
                    out[i] = text
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.string())], names=[*rest, column])

    return rows.transform(mapped, run, schema)
