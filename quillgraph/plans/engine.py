"""The engine: insert documents into a versioned graph, and answer batches of questions from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import entity_text, entity_type, UNKNOWN
from quillgraph.operators import chunking, context, graph, merge
from quillgraph.plans import retrieval, services
from quillgraph.plans.policies import Policies
from quillgraph.sources.scratch import Scratch
from quillgraph.sources.store import Store

NO_ANSWER = "No answer was found."
TABLES = ["entities", "relations", "chunks", "vectors", "e2r", "r2c"]
_EMPTY = {
    "entities": "name string, type string, description string",
    "relations": "edge_id long, source string, target string, description string, chunks array<long>",
    "chunks": "doc_id long, pos int, id long, content string, metadata string",
    "vectors": "id long, name string, embedding array<float>",
}


@dataclass
class Options:
    with_references: bool = False
    only_context: bool = False
    budgets: tuple[int, int, int] = context.BUDGETS


@dataclass
class Engine:
    spark: SparkSession
    root: str
    entity_types: list[str] = field(default_factory=lambda: ["PHRASE"])
    extractor: services.Extractor = field(default_factory=services.RuleExtractor)
    embedder: services.Embedder = field(default_factory=services.HashingEmbedder)
    writer: services.Writer = field(default_factory=services.QuotingWriter)
    summariser: services.Summariser = field(default_factory=services.AllSentences)
    policies: Policies = field(default_factory=Policies)
    limits: services.Limits = field(default_factory=services.Limits)
    keep: int = 3
    rounds: int = 20

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, self.keep)

    def tables(self) -> dict[str, DataFrame]:
        return self.store.load(TABLES) or {n: self.spark.createDataFrame([], s) for n, s in _EMPTY.items()}

    def insert(self, docs: DataFrame) -> tuple[int, int, int]:
        """docs (doc_id, text, metadata as JSON): chunk, drop known chunks, extract, merge, embed, link, commit. Counts of entities, relations and chunks of the graph afterwards.

        If nothing was extracted from the new chunks, they stay unknown and no version is written. A document one of whose
        chunks failed to the last is left out whole, and its chunks stay unknown, so that it can be inserted again.
        """
        scratch, old = Scratch(self.spark, "insert"), self.tables()
        chunks = scratch.table(chunking.new_only(chunking.chunks_of(docs.select("doc_id", "text", "metadata")), old["chunks"]).select("doc_id", "pos", "id", "content", "metadata"))
        answers = scratch.table(services.extract(chunks, self.extractor, self.limits))
        mentions = services.whole_documents(answers)
        arrival = F.struct("doc_id", "pos", "n")  # compared number by number: document 2 comes before document 10
        entities = mentions.where("kind = 'entity'").select(arrival.alias("ord"), F.col("a").alias("name"), entity_type(F.col("b"), self.entity_types).alias("type"), "description")
        found = scratch.table(self.policies.nodes(entities, old["entities"], self.policies.limit))
        if found.isEmpty():
            return self.counts(old)
        limit, shorten = self.policies.limit, self.summariser.shorten
        short = services.replaced(found.where("oversize").drop("oversize"), "description", lambda d: shorten(d, limit), ["description"], self.limits)
        found = scratch.table(found.where("NOT oversize").drop("oversize").unionByName(short))
        all_entities = scratch.table(old["entities"].join(found.select("name"), "name", "left_anti").unionByName(found))
        edges = mentions.where("kind = 'relation'").select(F.xxhash64("chunk_id", "doc_id", "a", "b", "description").alias("edge_id"), F.col("a").alias("source"), F.col("b").alias("target"), "description", F.array("chunk_id").alias("chunks"))
        edges = merge.valid_edges(edges.dropDuplicates(["edge_id"]), all_entities)
        relations = scratch.table(self.policies.edges(edges, old["relations"], self.policies.grouper, self.policies.threshold))
        texts = found.select("name", entity_text(F.coalesce("type", F.lit(UNKNOWN)), F.col("name"), F.col("description")).alias("text"))
        fresh = scratch.table(services.embed(texts, self.embedder, limits=self.limits).select(F.xxhash64("name").alias("id"), "name", "embedding"))
        vectors = scratch.table(old["vectors"].join(fresh.select("id"), "id", "left_anti").unionByName(fresh))
        alike = merge.identity_edges(vectors, relations, self.policies.alike, self.policies.alike_least, fresh.select("id", "embedding"), self.policies.search)
        relations = scratch.table(relations.unionByName(alike.select(F.xxhash64("source", "target", F.lit("is")).alias("edge_id"), "source", "target", "description", "chunks")))
        failed = answers.where("kind = 'failed'").select("doc_id").distinct()
        kept = old["chunks"].unionByName(chunks.join(failed, "doc_id", "left_anti"))
        new = {"entities": all_entities, "relations": relations, "chunks": kept, "vectors": vectors, "e2r": graph.entity_relations(relations), "r2c": graph.relation_chunks(relations, kept)}
        self.store.commit(new)
        self.store.vacuum()
        return self.counts(new)

    def counts(self, tables: dict[str, DataFrame] | None = None) -> tuple[int, int, int]:
        tables = tables or self.tables()
        return tuple(tables[n].count() for n in ("entities", "relations", "chunks"))

    def contexts(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """questions (query_id, text) -> entities, relations and chunks of each, ranked; None for an empty store."""
        t = self.tables()
        if t["vectors"].isEmpty():
            return None
        scratch = Scratch(self.spark, "query")
        asked = scratch.table(services.ask_entities(questions, self.extractor, self.limits))
        texts = retrieval.query_texts(asked).withColumn("text_id", F.xxhash64("query_id", "kind", "text")).dropDuplicates(["text_id"])
        texts = scratch.table(services.embed(texts, self.embedder, limits=self.limits))
        weights = retrieval.entity_weights(texts, t["vectors"].select("id", "embedding"))
        seeds = scratch.table(weights.join(t["vectors"].select("id", "name"), F.col("idx") == F.col("id")).select("query_id", "name", F.col("score").alias("weight")).where("weight > 0"))
        p = scratch.table(graph.personalized_pagerank(t["relations"], seeds, self.rounds))
        chunks = t["chunks"].groupBy("id").agg(F.min_by(F.struct("content", "metadata"), "doc_id").alias("c")).select("id", "c.*")  # of the first document
        return context.context_tables(p, t["entities"], t["relations"], chunks, t["e2r"], t["r2c"], (self.policies.entities, self.policies.relations, self.policies.chunks))

    def query(self, questions: DataFrame, options: Options | None = None) -> DataFrame:
        """query_id, response, context for each question; empty questions, and those that nothing fits, get the fixed failure answer."""
        options = options or Options()
        asked = questions.select("query_id", "text")
        tables = self.contexts(asked.where("trim(text) <> ''"))
        if tables is None:
            return asked.select("query_id", F.lit(NO_ANSWER).alias("response"), F.lit(None).cast("string").alias("context"))
        scratch = Scratch(self.spark, "answers")
        tables = tuple(map(scratch.table, tables))
        cut = context.truncate_context(context.context_lines(*tables), options.budgets)
        rows = asked.join(cut.select("query_id", "context"), "query_id", "left")
        rows = rows.withColumn("response", F.when(F.col("context").isNotNull(), F.lit("")))
        if not options.only_context:
            rows = services.replaced(rows.select("query_id", "text", "context", "response"), "response", self.writer.answer, ["text", "context"], self.limits)
        out = scratch.table(rows.select("query_id", F.coalesce("response", F.lit(NO_ANSWER)).alias("response"), "context"))
        if not options.with_references:
            return out
        held = tables[2].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "metadata", "content"))).alias("chunks"))
        cited = context.format_references(out.join(held, "query_id").select("query_id", "response", "chunks"))
        return out.drop("response").join(cited, "query_id", "left").select("query_id", F.coalesce("response", F.lit(NO_ANSWER)).alias("response"), "context", "references")

    def nodes(self, names: list[str]) -> list[tuple[str, str, str] | None]:
        """Name, type and description of each of these entities, None for one that is not in the graph."""
        asked = self.spark.createDataFrame(list(enumerate(names)), "pos int, name string")
        found = {r["pos"]: r for r in graph.nodes(self.tables()["entities"], asked).where("type IS NOT NULL").collect()}  # as many as were asked for
        return [(found[i]["name"], found[i]["type"], found[i]["description"]) if i in found else None for i in range(len(names))]

    def save_graphml(self, path: str) -> None:
        t = self.tables()
        graph.write_graphml(t["entities"], t["relations"], path)
