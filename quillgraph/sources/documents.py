"""Where documents, questions and graphs come from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import content_id
from quillgraph.operators.order import zipped


def with_metadata(contents: DataFrame, metadata: DataFrame) -> DataFrame:
    """contents (ord, data) and metadata (ord, metadata map) side by side by position, as many as the shorter has: pos, data, metadata."""
    left, right = contents.select(F.col("ord").alias("_a"), "data"), metadata.select(F.col("ord").alias("_b"), "metadata")
    return zipped(left, F.col("_a"), right, F.col("_b")).select("pos", "data", "metadata")


def with_one_metadata(contents: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """One metadata for all documents."""
    pairs = [F.lit(x) for kv in metadata.items() for x in kv]
    return contents.select("data", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))


def questions(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """A JSON array of {question, answer, context: [[title, [sentence]]], supporting_facts: [[title, n]]}; only the first so many, if asked."""
    schema = "question string, answer string, context array<string>, supporting_facts array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    passage = "array<string>"
    rows = rows.withColumns({
        "context": F.transform("context", lambda c: F.struct(F.from_json(c, passage)[0].alias("title"), F.from_json(F.from_json(c, passage)[1], passage).alias("sentences"))),
        "supporting_facts": F.array_distinct(F.transform("supporting_facts", lambda c: F.from_json(c, passage)[0])),
    })
    return rows.limit(first) if first else rows


def corpus(rows: DataFrame) -> DataFrame:
    """Passages (title, text) of questions, one of each text: the first of equal ones by title."""
    passages = rows.select(F.explode("context").alias("c")).select("c.title", F.array_join("c.sentences", "\n").alias("text"))
    return first_of_text(passages.withColumn("ord", F.col("title")))


def first_of_text(passages: DataFrame) -> DataFrame:
    """Of passages (ord, title, text) with the same text, the first, with its XXH3 id."""
    rest = [c for c in passages.columns if c != "text"]
    one = passages.groupBy("text").agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("_x"))
    return one.select(content_id("text").alias("id"), *[F.col(f"_x.{c}").alias(c) for c in rest if c != "ord"], "text")


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.select("question", "answer", F.col("supporting_facts").alias("evidence"))


def parse_subgraph(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with an extractor's JSON -> entities, relations, and the rows whose JSON can't be read.

    Names, types and ends are in upper case, `desc` becomes description, other_relationships follow relationships. To
    mend what can be mended first, put the column through repaired().
    """
    entity, edge = "array<struct<name:string,type:string,desc:string>>", "array<struct<source:string,target:string,desc:string>>"
    rest = [c for c in rows.columns if c != column]
    parsed = rows.withColumn("_g", F.from_json(column, f"struct<entities:{entity},relationships:{edge},other_relationships:{edge},_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = parsed.where(F.col("_g").isNull() | F.col("_g._corrupt").isNotNull()).select(*rest, column)
    good = parsed.where(F.col("_g").isNotNull() & F.col("_g._corrupt").isNull())
    entities = good.select(*rest, F.posexplode("_g.entities").alias("pos", "e")).select(*rest, "pos", F.upper("e.name").alias("name"), F.upper("e.type").alias("type"), F.col("e.desc").alias("description"))
    ties = F.concat(F.coalesce("_g.relationships", F.array().cast(edge)), F.coalesce("_g.other_relationships", F.array().cast(edge)))
    relations = good.select(*rest, F.posexplode(ties).alias("pos", "e")).select(*rest, "pos", F.upper("e.source").alias("source"), F.upper("e.target").alias("target"), F.col("e.desc").alias("description"))
    return entities, relations, bad


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """A model's answer as plain JSON: without what stands around it, and with slips of notation mended. Null for text without any."""
    import json

    from quillgraph.functions.repair import read_json

    def one(text):
        try:
            return None if text is None else json.dumps(read_json(text), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def write_vectors_json(vectors: DataFrame, path: str) -> None:
    """JSON lines of id and base-64 vector."""
    from quillgraph.functions.vectors import to_base64

    vectors.select("id", to_base64(F.col("embedding").cast("array<float>")).alias("vector")).write.json(path)


def read_vectors_json(spark: SparkSession, path: str) -> DataFrame:
    from quillgraph.functions.vectors import from_base64

    return spark.read.schema("id long, vector string").json(path).select("id", from_base64("vector").alias("embedding"))


def write_results(results: DataFrame, path: str) -> None:
    """Results of a benchmark as one JSON array on the driver, indented by 4; rows stream through and are never held together."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(results.toLocalIterator()):
            lines = json.dumps(row.asDict(recursive=True), indent=4, ensure_ascii=False).split("\n")
            f.write(("," if i else "") + "".join(f"\n    {line}" for line in lines))
        f.write("\n]\n")


def titles_in(context: Column, most: int = 8) -> Column:
    """Titles of the passages that a rendered context lists under its sources, in order: what stands before the first colon of each item."""
    sources = F.regexp_extract(context, r"(?s)## Sources\n(.*)$", 1)
    found = F.regexp_extract_all(sources, F.lit(r"(?m)^\[\d+\]  ([^:\n]+):"), 1)
    return F.slice(found, 1, most)
