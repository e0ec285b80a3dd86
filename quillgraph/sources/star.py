"""A knowledge graph of the star schema: customers, suppliers, nations and regions, with orders as the text chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    entities: DataFrame  # name, type, description
    relations: DataFrame  # edge_id, source, target, description, chunks
    chunks: DataFrame  # id, content, metadata


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, supplier, nation, region, orders = map(read, ("customer", "supplier", "nation", "region", "orders"))
    kinds = ((customer, "C", "c_custkey", "c_name", "CUSTOMER"), (supplier, "S", "s_suppkey", "s_name", "SUPPLIER"), (nation, "N", "n_nationkey", "n_name", "NATION"), (region, "R", "r_regionkey", "r_name", "REGION"))
    entities = [df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("type"), F.col(text).alias("description")) for df, letter, key, text, kind in kinds]
    end = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    bought = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("chunks"))
    none = F.array().cast("array<bigint>")
    ties = [
        customer.join(bought, "c_custkey", "left").select(end("C", "c_custkey").alias("source"), end("N", "c_nationkey").alias("target"), F.lit("lives in").alias("description"), F.coalesce("chunks", none).alias("chunks")),
        supplier.select(end("S", "s_suppkey"), end("N", "s_nationkey"), F.lit("sells from"), none),
        nation.select(end("N", "n_nationkey"), end("R", "n_regionkey"), F.lit("lies in"), none),
    ]
    relations = ties[0].unionAll(ties[1]).unionAll(ties[2]).select(F.concat("source", F.lit(">"), "target").alias("edge_id"), "source", "target", "description", "chunks")
    content = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of priority "), F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus"))
    chunks = orders.select(F.col("o_orderkey").alias("id"), content.alias("content"), F.to_json(F.struct("o_custkey")).alias("metadata"))
    return Graph(entities[0].unionAll(entities[1]).unionAll(entities[2]).unionAll(entities[3]), relations, chunks)


SEEDS = [(1, "N3", 1.0), (1, "C10", 1.0), (2, "R1", 1.0), (2, "S5", 0.5)]


def seeds(spark: SparkSession) -> DataFrame:
    """Two questions: what is near nation 3 and customer 10, and near region 1 and, half as much, supplier 5?"""
    return spark.createDataFrame(SEEDS, "query_id long, name string, weight double")
