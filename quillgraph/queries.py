"""One query for each operator over the test tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text, vectors
from quillgraph.operators import ann, chunking, context, graph, kv, merge, order, ranking, vector
from quillgraph.plans import retrieval, services
from quillgraph.sources import documents, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROUNDS = 20
ALLOWED_TYPES = ["STANDARD POLISHED", "promo_brushed", "Economy Anodized"]


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents and text -------------------------------------------------------------------------------------------


@query("""SELECT a.pos, a.text AS data, b.quality::VARCHAR AS quality FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text FROM documents) a
  JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality FROM labels) b USING (pos)""")
def doc_source(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("data"))
    meta = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    return documents.with_metadata(docs, meta).select("pos", "data", F.col("metadata")["quality"].alias("quality"))


@query("SELECT doc_id, 0::INTEGER AS pos, text AS content FROM documents WHERE length(text) <= 3200")
def chunk_short(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where(F.length("text") <= chunking.CHUNK_LETTERS)
    return chunking.chunk(docs.select("doc_id", "text"))


@query()
def chunk_docs(spark, sf_dir):
    return chunking.chunk(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pos", F.length("content").alias("n_chars"), F.md5("content").alias("md5"))


@query()
def chunk_ids(spark, sf_dir):
    return chunking.chunks_of(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pos", "id")


@query("SELECT conv_id, min(turn) AS turn, text FROM conversations GROUP BY conv_id, text")
def chunk_dedup(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").withColumn("id", F.md5("text"))
    return chunking.first_in_document(turns, "conv_id", "id", "turn").select("conv_id", "turn", "text")


@query("SELECT c_custkey AS id, c_name AS content FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def filter_new_chunks(spark, sf_dir):
    incoming = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))
    return chunking.new_only(incoming, _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT doc_id, source AS title, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def corpus_dedup(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "doc_id", F.col("source").alias("title"), "text")
    return documents.first_of_text(rows).select("doc_id", "title", F.md5("text").alias("text_md5"))


@query("SELECT p_partkey, upper(p_name) AS name, upper(p_type) AS type FROM part")
def upper_entities(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), F.upper("p_type").alias("type"))


@query("""SELECT p_partkey, CASE WHEN upper(replace(replace(p_type, ' ', ''), '_', '')) IN ('STANDARDPOLISHED', 'PROMOBRUSHED', 'ECONOMYANODIZED')
  THEN upper(replace(replace(p_type, ' ', ''), '_', '')) ELSE 'UNKNOWN' END AS type FROM part""")
def entity_type_filter(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.entity_type(F.col("p_type"), ALLOWED_TYPES).alias("type"))


@query("""SELECT p_partkey, '[' || p_type || '] ' || p_brand || CASE WHEN length(p_name) > 0 THEN chr(10) || '[DESCRIPTION] ' || p_name ELSE '' END AS entity_text FROM part""")
def entity_text(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.entity_text(F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("entity_text"))


@query("""SELECT n_nationkey::BIGINT AS query_id, 'named' AS kind, n_name AS text FROM nation UNION ALL
  SELECT n_nationkey::BIGINT, 'generic', '[NONE] ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT n_nationkey::BIGINT, 'question', 'Who trades with ' || n_name || '?' FROM nation""")
def query_texts(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("Who trades with "), "n_name", F.lit("?")).alias("text"), F.array("n_name").alias("named"), F.array("r_name").alias("generic"))
    return retrieval.query_texts(asked)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::BIGINT AS n_tokens FROM documents""")
def token_count(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query(r"""SELECT doc_id, CASE WHEN n <= 500 THEN n END AS n_tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::BIGINT AS n FROM documents)""")
def token_limit(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.within_limit(F.col("text"), 500).alias("n_tokens"))


@query(r"""SELECT conv_id, turn, role || chr(9) || replace(replace(text, chr(10), '  '), chr(9), ' ') || chr(9) || turn::VARCHAR AS line FROM conversations""")
def tsv_rows(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.tsv_row(F.col("role"), F.col("text"), F.col("turn")).alias("line"))


@query(r"""SELECT item_id, '[' || row_number() OVER (ORDER BY item_id) || ']  ' || text || chr(10) || '=====' || chr(10) || chr(10) AS item FROM benchmark""")
def reference_list(spark, sf_dir):
    items = order.with_position(_read(spark, sf_dir, "benchmark"), F.col("item_id"))
    return items.select("item_id", text.reference_item(F.col("pos") + 1, F.col("text")).alias("item"))


@query("""SELECT s_suppkey, 'Describe {' || s_name || '} of nation ' || s_nationkey || '.' AS prompt FROM supplier""")
def render_prompt(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", text.prompt("Describe {{{name}}} of nation {nation}.", name=F.col("s_name"), nation=F.col("s_nationkey")).alias("prompt"))


@query("SELECT c_name, c_mktsegment FROM customer")
def project_fields(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_name", "c_mktsegment")


@query("""SELECT p_partkey, 'entity' AS kind, upper(p_name) AS a, upper(p_type) AS b, p_brand AS description FROM part UNION ALL
  SELECT p_partkey, 'relation', upper(p_name), upper(p_brand), 'made by' FROM part UNION ALL SELECT p_partkey, 'relation', upper(p_brand), upper(p_type), 'offers' FROM part""")
def parse_subgraph_json(spark, sf_dir):
    edge = lambda a, b, d: F.array(F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(d).alias("desc")))
    entity = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("desc")))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(entity.alias("entities"), edge("p_name", "p_brand", "made by").alias("relationships"), edge("p_brand", "p_type", "offers").alias("other_relationships"))).alias("json"))
    entities, relations, _ = documents.parse_subgraph(rows)
    return entities.select("p_partkey", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), "description").unionAll(relations.select("p_partkey", F.lit("relation"), "source", "target", "description"))


# --- merging ------------------------------------------------------------------------------------------------------

_PART_MENTIONS = "SELECT p_partkey AS ord, p_brand AS name, split_part(p_type, ' ', 1) AS type, p_name AS description FROM part"


def _mentions(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), F.col("p_name").alias("description"))


def _stored_brands(spark, sf_dir):
    return _read(spark, sf_dir, "part").where("p_size >= 50").select(F.col("p_brand").alias("name"), F.lit("BRAND").alias("type"), F.concat(F.lit("Known as "), "p_brand").alias("description")).distinct()


_MERGED = f"""WITH m AS ({_PART_MENTIONS}), s AS (SELECT DISTINCT p_brand AS name, 'BRAND' AS type, 'Known as ' || p_brand AS description FROM part WHERE p_size >= 50),
  r AS (SELECT *, 0 AS late FROM m UNION ALL SELECT 0 AS ord, name, type, description, 1 AS late FROM s WHERE name IN (SELECT name FROM m)),
  t AS (SELECT name, type FROM (SELECT name, type, count(*) AS n, min(late * 1e15 + ord) AS first FROM r GROUP BY name, type) QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, first) = 1),
  d AS (SELECT name, string_agg(description, chr(10) ORDER BY late, ord) AS description FROM r GROUP BY name)"""


@query(f"{_MERGED} SELECT name, type, description FROM t JOIN d USING (name)")
def merge_entities(spark, sf_dir):
    return merge.merge_entities(_mentions(spark, sf_dir), _stored_brands(spark, sf_dir)).drop("oversize")


@query(f"{_MERGED} SELECT name, length(description) > 512 AS oversize FROM d")
def entity_oversize(spark, sf_dir):
    return merge.merge_entities(_mentions(spark, sf_dir), _stored_brands(spark, sf_dir)).select("name", "oversize")


@query(f"SELECT name, type, description FROM ({_PART_MENTIONS}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1")
def node_upsert_last(spark, sf_dir):
    return merge.last_wins(_mentions(spark, sf_dir))


@query("SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, l_orderkey::VARCHAR AS chunks, l_linenumber FROM lineitem")
def relation_provenance(spark, sf_dir):
    rows = _sales(spark, sf_dir).withColumn("chunks", F.array("l_orderkey"))
    return rows.select("source", "target", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"), "l_linenumber")


def _sales(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("""SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, l_orderkey, l_linenumber FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def valid_edges(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").where("p_size <= 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    suppliers = _read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return merge.valid_edges(_sales(spark, sf_dir).select("source", "target", "l_orderkey", "l_linenumber"), parts.unionAll(suppliers))


def _brand_edges(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = _read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.col("p_brand").alias("target"), F.concat("l_returnflag", "l_linestatus").alias("description"), F.array("l_orderkey").alias("chunks"), "l_returnflag")
    return rows.where("l_returnflag = 'N'").drop("l_returnflag"), rows.where("l_returnflag <> 'N'").drop("l_returnflag")


_BRAND_EDGES = """e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'S' || l_suppkey AS source, p_brand AS target, l_returnflag || l_linestatus AS description, l_orderkey AS chunk,
  (l_returnflag = 'N')::INTEGER AS fresh FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {_BRAND_EDGES} SELECT source, target, (count(*) - sum(fresh))::BIGINT AS n_stored, sum(fresh)::BIGINT AS n_new, count(*) > 5 AS merge,
  md5(string_agg(i || ', ' || description, chr(10) ORDER BY i)) AS listing_md5
  FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY fresh, edge_id, description) - 1 AS i FROM e) GROUP BY source, target HAVING sum(fresh) > 0""")
def edge_merge_groups(spark, sf_dir):
    return merge.edge_groups(*_brand_edges(spark, sf_dir)).withColumn("listing_md5", F.md5("listing")).drop("listing")


@query(f"""WITH {_BRAND_EDGES}, p AS (SELECT *, count(*) OVER w > 5 AND max(fresh) OVER w = 1 AS merge FROM e WINDOW w AS (PARTITION BY source, target))
  SELECT arg_min(edge_id, fresh * 1000000000000 + edge_id) AS edge_id, source, target, description, count(DISTINCT chunk)::BIGINT AS n_chunks, sum(DISTINCT chunk)::BIGINT AS chunk_sum FROM p WHERE merge GROUP BY source, target, description
  UNION ALL SELECT edge_id, source, target, description, 1, chunk FROM p WHERE NOT merge""")
def edge_merge_apply(spark, sf_dir):
    out = merge.merge_edges(*_brand_edges(spark, sf_dir))
    return out.select("edge_id", "source", "target", "description", F.size("chunks").cast("long").alias("n_chunks"), F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x).alias("chunk_sum"))


# --- the star graph -----------------------------------------------------------------------------------------------

_REL = """rel AS (SELECT 'C' || c_custkey || '>N' || c_nationkey AS edge_id, 'C' || c_custkey AS source, 'N' || c_nationkey AS target FROM customer UNION ALL
  SELECT 'S' || s_suppkey || '>N' || s_nationkey, 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL
  SELECT 'N' || n_nationkey || '>R' || n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
e2r AS (SELECT name, edge_id, count(*) AS weight FROM (SELECT source AS name, edge_id FROM rel UNION ALL SELECT target, edge_id FROM rel) GROUP BY ALL),
r2c AS (SELECT 'C' || c_custkey || '>N' || c_nationkey AS edge_id, o_orderkey AS chunk_id, count(*) AS weight FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
ent AS (SELECT 'C' || c_custkey AS name FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT 'N' || n_nationkey FROM nation UNION ALL SELECT 'R' || r_regionkey FROM region)"""


def _ppr_sql(seeds: str) -> str:
    """Common table expressions for the mass p<ROUNDS> (query_id, idx, score) after all rounds."""
    parts = [
        f"sd AS ({seeds})",
        "rs AS (SELECT query_id, name AS idx, sum(weight) / sum(sum(weight)) OVER (PARTITION BY query_id) AS r FROM sd GROUP BY query_id, name)",
        "ad AS MATERIALIZED (SELECT u, v, n / sum(n) OVER (PARTITION BY u) AS w FROM (SELECT u, v, count(*) AS n FROM (SELECT source AS u, target AS v FROM rel UNION ALL SELECT target, source FROM rel) GROUP BY u, v))",
        "p0 AS (SELECT query_id, idx, r AS score FROM rs)",
    ]
    for i in range(ROUNDS):
        parts.append(f"m{i} AS MATERIALIZED (SELECT query_id, v AS idx, sum(score * w) * {graph.DAMPING} AS score FROM p{i} JOIN ad ON idx = u GROUP BY query_id, v)")
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT query_id, idx, sum(score) AS score FROM (SELECT * FROM m{i} UNION ALL SELECT rs.query_id, rs.idx, (1 - coalesce(g, 0)) * r FROM rs LEFT JOIN (SELECT query_id, sum(score) AS g FROM m{i} GROUP BY query_id) t ON rs.query_id = t.query_id) GROUP BY query_id, idx)")
    return ",\n".join(parts)


_SEEDS = " UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, '{n}' AS name, {w}::DOUBLE AS weight" for q, n, w in star.SEEDS)


@query(f"WITH {_REL} SELECT name, edge_id, weight FROM e2r")
def e2r_map(spark, sf_dir):
    return graph.entity_relations(star.star_graph(spark, sf_dir).relations)


@query(f"WITH {_REL} SELECT edge_id, chunk_id, weight FROM r2c")
def r2c_map(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return graph.relation_chunks(g.relations, g.chunks)


@query(f"WITH {_REL} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM orders) AS chunks")
def graph_counts(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    counts = [df.select(F.lit(n).alias("k")) for n, df in (("entities", g.entities), ("relations", g.relations), ("chunks", g.chunks))]
    rows = counts[0].unionAll(counts[1]).unionAll(counts[2])
    return rows.agg(*[F.count(F.when(F.col("k") == n, 1)).alias(n) for n in ("entities", "relations", "chunks")])


@query(f"WITH {_REL} SELECT edge_id, source, target FROM rel WHERE (source, target) IN (SELECT ('C' || c_custkey, 'N' || c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT ('N' || c_nationkey, 'C' || c_custkey) FROM customer)")
def edges_between(spark, sf_dir):
    customer = _read(spark, sf_dir, "customer")
    c, n = F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    pairs = customer.where("c_mktsegment = 'BUILDING'").select(c.alias("source"), n.alias("target")).unionAll(customer.select(n, c))
    return graph.edges_between(star.star_graph(spark, sf_dir).relations, pairs).select("edge_id", "source", "target")


@query(f"WITH {_REL},\n{_ppr_sql(_SEEDS)} SELECT query_id, idx, round(score, 9) AS score FROM p{ROUNDS}")
def ppr(spark, sf_dir):
    return graph.personalized_pagerank(star.star_graph(spark, sf_dir).relations, star.seeds(spark), ROUNDS).withColumn("score", F.round("score", 9))


@query(f"WITH {_REL},\n{_ppr_sql('SELECT 0::BIGINT AS query_id, name, 1.0::DOUBLE AS weight FROM ent')} SELECT idx, round(score, 9) AS score FROM p{ROUNDS}")
def pagerank(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return graph.pagerank(g.entities, g.relations, ROUNDS).select("idx", F.round("score", 9).alias("score"))


_BALANCES = """sc AS (SELECT 1::BIGINT AS query_id, 'C' || c_custkey AS idx, c_acctbal / 10000 AS score FROM customer WHERE c_acctbal > 0 UNION ALL
  SELECT 2::BIGINT, 'S' || s_suppkey, s_acctbal / 10000 FROM supplier WHERE s_acctbal > 0)"""


def _balances(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit(1).cast("long").alias("query_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("idx"), (F.col("c_acctbal") / 10000).alias("score"))
    return c.unionAll(_read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit(2).cast("long"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_acctbal") / 10000))


@query(f"WITH {_REL}, {_BALANCES} SELECT query_id, edge_id AS idx, round(sum(score * weight), 6) AS score FROM sc JOIN e2r ON idx = name GROUP BY query_id, edge_id")
def score_relations(spark, sf_dir):
    e2r = graph.entity_relations(star.star_graph(spark, sf_dir).relations)
    return context.propagate(_balances(spark, sf_dir), e2r, "name", "edge_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_REL}, {_BALANCES}, er AS (SELECT query_id, edge_id, sum(score * weight) AS score FROM sc JOIN e2r ON idx = name GROUP BY query_id, edge_id) SELECT query_id, chunk_id AS idx, round(sum(score * weight), 6) AS score FROM er JOIN r2c USING (edge_id) GROUP BY query_id, chunk_id")
def score_chunks(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    edges = context.propagate(_balances(spark, sf_dir), graph.entity_relations(g.relations), "name", "edge_id")
    return context.propagate(edges, graph.relation_chunks(g.relations, g.chunks), "edge_id", "chunk_id").withColumn("score", F.round("score", 6))


def _contexts(spark, sf_dir, rounds: int = ROUNDS, digits: int = 12):
    g = star.star_graph(spark, sf_dir)
    p = graph.personalized_pagerank(g.relations, star.seeds(spark), rounds).withColumn("score", F.round("score", digits))
    return context.context_tables(p, g.entities, g.relations, g.chunks, graph.entity_relations(g.relations), graph.relation_chunks(g.relations, g.chunks))


@query(f"""WITH {_REL},\n{_ppr_sql(_SEEDS)},
en AS (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx)::INTEGER AS rank FROM (SELECT query_id, idx, round(score, 12) AS score FROM p{ROUNDS}) WHERE score >= 0.005 QUALIFY rank <= 128),
re AS (SELECT query_id, edge_id AS idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id)::INTEGER AS rank FROM (SELECT query_id, edge_id, sum(score * weight) AS score FROM en JOIN e2r ON idx = name GROUP BY query_id, edge_id) QUALIFY rank <= 64),
ch AS (SELECT query_id, chunk_id AS idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (SELECT query_id, chunk_id, sum(score * weight) AS score FROM re JOIN r2c ON idx = edge_id GROUP BY query_id, chunk_id) QUALIFY rank <= 8)
SELECT query_id, 'entity' AS kind, idx AS key, rank, round(score, 9) AS score FROM en UNION ALL SELECT query_id, 'relation', idx, rank, round(score, 9) FROM re UNION ALL SELECT query_id, 'chunk', idx::VARCHAR, rank, round(score, 9) FROM ch""")
def context_tables(spark, sf_dir):
    entities, relations, chunks = _contexts(spark, sf_dir)
    row = lambda df, kind, key: df.select("query_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "rank", F.round("score", 9).alias("score"))
    return row(entities, "entity", "name").unionAll(row(relations, "relation", "edge_id")).unionAll(row(chunks, "chunk", "id"))


@query()
def truncate_context(spark, sf_dir):
    return context.truncate_context(context.context_lines(*_contexts(spark, sf_dir)))


@query()
def response_json(spark, sf_dir):
    tables = _contexts(spark, sf_dir)
    return context.response_json(*tables, star.seeds(spark).select("query_id", F.lit("See [1].").alias("response")).distinct())


@query()
def format_references(spark, sf_dir):
    *_, chunks = _contexts(spark, sf_dir)
    held = chunks.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "metadata", "content"))), lambda x: F.struct(x["id"].alias("id"), x["metadata"].alias("metadata"), x["content"].alias("content"))).alias("chunks"))
    return context.format_references(held.withColumn("response", F.lit("As [2][1] and [9] say, [3].")))


def _xml_sql(value: str) -> str:
    return f"replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""WITH {_REL}, names AS (SELECT 'C' || c_custkey AS name, 'CUSTOMER' AS type, c_name AS description FROM customer UNION ALL SELECT 'S' || s_suppkey, 'SUPPLIER', s_name FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, 'REGION', r_name FROM region)
  SELECT 1 AS part, name AS key, '<node id="' || {_xml_sql("name")} || '"><data key="type">' || {_xml_sql("type")} || '</data><data key="description">' || {_xml_sql("coalesce(description, '')")} || '</data></node>' AS line FROM names
  UNION ALL SELECT 2, edge_id, '<edge source="' || {_xml_sql("source")} || '" target="' || {_xml_sql("target")} || '"><data key="relation">' || CASE left(source, 1) WHEN 'C' THEN 'lives in' WHEN 'S' THEN 'sells from' ELSE 'lies in' END || '</data></edge>' FROM rel""")
def graphml_rows(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return graph.graphml_rows(g.entities, g.relations)


# --- ranking ------------------------------------------------------------------------------------------------------

_SCORES = "sc AS (SELECT c_nationkey::BIGINT AS query_id, c_custkey AS idx, greatest(c_acctbal, 0) / 10000 AS score FROM customer)"


def _scores(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("idx"), (F.greatest("c_acctbal", F.lit(0.0)) / 10000).alias("score"))


_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx)"


@query(f"WITH {_SCORES} SELECT query_id, idx, round(score, 6) AS score, {_BEST}::INTEGER AS rank FROM sc WHERE score <> 0")
def sorted_scores(spark, sf_dir):
    return ranking.sorted_scores(_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES} SELECT query_id, idx, round(score, 6) AS score FROM sc WHERE score >= 0.05 QUALIFY {_BEST} <= 128")
def rank_threshold(spark, sf_dir):
    return ranking.threshold(_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES} SELECT query_id, idx, round(score, 6) AS score FROM sc WHERE score <> 0 QUALIFY {_BEST} <= 10")
def rank_topk(spark, sf_dir):
    return ranking.top_k(_scores(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SCORES}, g AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w - score AS gap FROM sc WHERE score <> 0 WINDOW w AS (PARTITION BY query_id ORDER BY score, idx DESC)),
  c AS (SELECT query_id, arg_max(r, gap) AS cut FROM (SELECT * FROM g WHERE gap IS NOT NULL ORDER BY query_id, r) GROUP BY query_id)
  SELECT query_id, idx, round(score, 6) AS score FROM g LEFT JOIN c USING (query_id) WHERE cut IS NULL OR r > cut""")
def rank_elbow(spark, sf_dir):
    return ranking.elbow(_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES} SELECT query_id, idx, round(score / (sum(score) OVER (PARTITION BY query_id) + 1e-8), 9) AS score FROM sc")
def normalize_scores(spark, sf_dir):
    return vector.normalise_scores(_scores(spark, sf_dir)).withColumn("score", F.round("score", 9))


# --- vectors ------------------------------------------------------------------------------------------------------

_COS = """n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM n a, n b WHERE a.vec_id % 50 = 0)"""
_NEAREST = "row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)"


def _store(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark, sf_dir):
    """The stated query set: every vector whose id 50 divides."""
    return _store(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding", "label")


@query(f"WITH {_COS} SELECT query_id, id, round((1 + c) / 2, 6) AS score, {_NEAREST}::INTEGER AS rank FROM s QUALIFY rank <= 10")
def knn(spark, sf_dir):
    return vector.knn(_asked(spark, sf_dir), _store(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS} SELECT query_id, id, round(c, 6) AS score, {_NEAREST}::INTEGER AS rank FROM s QUALIFY rank <= 10")
def knn_cosine(spark, sf_dir):
    return vector.knn(_asked(spark, sf_dir), _store(spark, sf_dir), 10, vector.COSINE).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS} SELECT query_id, id AS idx, round((1 + c) / 2, 6) AS score FROM (SELECT * FROM s QUALIFY {_NEAREST} <= 20) WHERE (1 + c) / 2 >= 0.6")
def score_all(spark, sf_dir):
    return vector.score_all(_asked(spark, sf_dir), _store(spark, sf_dir), 20, 0.6).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS} SELECT query_id, id AS idx, round(c, 6) AS score FROM (SELECT * FROM s QUALIFY {_NEAREST} <= 20) WHERE c >= 0.2")
def score_all_cosine(spark, sf_dir):
    return vector.score_all(_asked(spark, sf_dir), _store(spark, sf_dir), 20, 0.2, vector.COSINE).withColumn("score", F.round("score", 6))


@query(f"""WITH {_COS}, t AS (SELECT *, {_NEAREST} AS r, (1 + c) / 2 AS score FROM s), q AS (SELECT vec_id, label AS group_id FROM embeddings),
  k AS (SELECT t.query_id, id, score, group_id FROM t JOIN q ON query_id = vec_id WHERE (group_id % 2 = 0 AND r <= 1 AND score >= 0.7) OR (group_id % 2 = 1 AND r <= 20 AND score >= 0.5)),
  w AS (SELECT group_id, id, score / (sum(score) OVER (PARTITION BY query_id) + 1e-8) AS score FROM k)
  SELECT group_id::BIGINT AS query_id, id AS idx, round(max(score), 6) AS score FROM w GROUP BY group_id, id""")
def entity_weights(spark, sf_dir):
    texts = _asked(spark, sf_dir).select(F.col("query_id").alias("text_id"), F.col("label").cast("long").alias("query_id"), F.when(F.col("label") % 2 == 0, "named").otherwise("generic").alias("kind"), "embedding")
    return retrieval.entity_weights(texts, _store(spark, sf_dir)).withColumn("score", F.round("score", 6))


_CHAIN = "SELECT 'V' || vec_id AS a, 'V' || (vec_id + 1) AS b FROM embeddings"


@query(f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM n a, n b), t AS (SELECT * FROM s QUALIFY {_NEAREST} <= 3)
  SELECT 'V' || query_id AS source, 'V' || id AS target, 'is' AS description FROM t WHERE (1 + c) / 2 >= 0.7 AND id > query_id
  AND ('V' || query_id, 'V' || id) NOT IN (SELECT (a, b) FROM ({_CHAIN})) AND ('V' || id, 'V' || query_id) NOT IN (SELECT (a, b) FROM ({_CHAIN}))""")
def identity_edges(spark, sf_dir):
    vectors_ = _store(spark, sf_dir).select("id", F.concat(F.lit("V"), F.col("id").cast("string")).alias("name"), "embedding")
    chain = vectors_.select(F.col("name").alias("source"), F.concat(F.lit("V"), (F.col("id") + 1).cast("string")).alias("target"))
    return merge.identity_edges(vectors_, chain, 3, 0.7).drop("chunks")


@query("""SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS total
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""")
def vec_normalize(spark, sf_dir):
    unit = _read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id AS id, CASE label WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'keep' END AS change FROM embeddings")
def vec_upsert(spark, sf_dir):
    rows = _store(spark, sf_dir)
    new = rows.where("label IN (0, 1)").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    return vector.upsert(rows.where("label <> 0").select("id", "embedding"), new).select("id", "change")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 3")
def vec_delete(spark, sf_dir):
    rows = _store(spark, sf_dir).select("id", "label")
    return vector.delete(rows, rows.where("label = 3"))


@query(f"WITH {_COS} SELECT query_id, id, round(c, 6) AS score, {_NEAREST}::INTEGER AS rank FROM s WHERE label = 1 QUALIFY rank <= 10 AND c >= 0.1")
def vec_query_filtered(spark, sf_dir):
    return vector.query(_asked(spark, sf_dir), _store(spark, sf_dir), 10, 0.1, F.col("label") == 1).withColumn("score", F.round("score", 6))


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT a.label AS tenant, a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM n a JOIN n b ON a.label = b.label WHERE a.vec_id % 50 = 0)
  SELECT tenant, query_id, id, round(c, 6) AS score, row_number() OVER (PARTITION BY tenant, query_id ORDER BY c DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def tenant_query(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumnRenamed("label", "tenant")
    return vector.tenant_query(asked, _store(spark, sf_dir).withColumnRenamed("label", "tenant"), 5, 9).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS} SELECT query_id, {_NEAREST}::INTEGER AS rank, id, round(c, 6) AS score, text FROM s JOIN documents ON doc_id = id QUALIFY rank <= 8")
def naive_retrieval(spark, sf_dir):
    texts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    store = _store(spark, sf_dir).join(texts.select("id"), "id", "left_semi")
    return retrieval.naive(_asked(spark, sf_dir), store, texts).withColumn("score", F.round("score", 6))


@query()
def vec_base64(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", vectors.to_base64("embedding").alias("base64"), vectors.vector_id("embedding").alias("content_id"))


# --- key-value store ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS pos, o_custkey AS key, c.c_custkey AS idx, c.c_name AS value FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c.c_custkey")
def kv_lookup(spark, sf_dir):
    store = _read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("idx"), F.col("c_name").alias("value"))
    return kv.lookup(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("key")), store)


@query("""WITH st AS (SELECT c_name AS key, c_custkey AS idx, c_mktsegment AS value FROM customer WHERE c_acctbal >= 0),
  nw AS (SELECT c_custkey AS ord, c_name AS key, 'seen' AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 1000000000 + s_suppkey, 'T ' || s_name, 'seller' FROM supplier),
  fr AS (SELECT *, row_number() OVER (ORDER BY ord, key) AS n FROM nw WHERE key NOT IN (SELECT key FROM st)),
  fi AS (SELECT i AS free, row_number() OVER (ORDER BY i DESC) AS n FROM range((SELECT max(idx) + 1 FROM st)) t(i) WHERE i NOT IN (SELECT idx FROM st))
  SELECT st.key, st.idx, coalesce(nw.value, st.value) AS value FROM st LEFT JOIN nw ON st.key = nw.key UNION ALL
  SELECT key, coalesce(free, (SELECT max(idx) FROM st) + fr.n - (SELECT count(*) FROM fi)), value FROM fr LEFT JOIN fi ON fr.n = fi.n""")
def kv_upsert(spark, sf_dir):
    customer = _read(spark, sf_dir, "customer")
    store = customer.where("c_acctbal >= 0").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("value"))
    new = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("key"), F.lit("seen").alias("value"))
    return kv.upsert(store, new.unionAll(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 1_000_000_000, F.concat(F.lit("T "), "s_name"), F.lit("seller"))))


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def kv_delete(spark, sf_dir):
    store = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return kv.delete(store, _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


# --- services and evaluation --------------------------------------------------------------------------------------


@query()
def hash_embed(spark, sf_dir):
    return services.embed(_read(spark, sf_dir, "documents").select("doc_id", "text"), services.HashingEmbedder()).drop("text")


@query()
def extract_mentions(spark, sf_dir):
    chunks = chunking.chunks_of(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return services.extract(chunks, services.RuleExtractor())


@query()
def ann_search(spark, sf_dir):
    """Approximate neighbours of the rows that 50 divides: an inverted file, as many cells as its sample needs."""
    store = _store(spark, sf_dir).select("id", "embedding")
    return ann.search(ann.build(store), _asked(spark, sf_dir).select("query_id", "embedding"), 5, metric=vector.COSINE)


@query()
def query_entities(spark, sf_dir):
    return services.ask_entities(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), services.RuleExtractor())


@query("""WITH r AS (SELECT user_id, list(DISTINCT event_type) FILTER (value < 50) AS evidence, list(DISTINCT event_type) FILTER (value >= 50) AS truth FROM events GROUP BY user_id),
  q AS (SELECT CASE WHEN len(coalesce(truth, [])) > 0 THEN len(list_intersect(truth, coalesce(evidence, [])))::DOUBLE / len(truth) ELSE 0 END AS recall, len(coalesce(truth, [])) >= 2 AS multihop FROM r)
  SELECT subset, count(*) AS n, round(avg((recall = 1)::INTEGER), 9) AS perfect, round(avg(recall), 9) AS mean_recall FROM (SELECT 'all' AS subset, recall FROM q UNION ALL SELECT 'multihop', recall FROM q WHERE multihop) GROUP BY subset""")
def perfect_retrieval(spark, sf_dir):
    kinds = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(kinds(F.col("value") < 50).alias("evidence"), kinds(F.col("value") >= 50).alias("truth"))
    found = retrieval.perfect_retrieval(rows.withColumn("multihop", F.size("truth") >= 2))
    return found.select("subset", "n", F.round("perfect", 9).alias("perfect"), F.round("mean_recall", 9).alias("mean_recall"))
