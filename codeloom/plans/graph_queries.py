"""Graph, service, parsing and maintenance operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import (
    calls,
    changes,
    chunking,
    definitions,
    expansion,
    exports,
    graph,
    keyed,
    linking,
    services,
)
from codeloom.plans.registry import query, spread_table, table, wide_ints
from codeloom.plans.table_queries import _LINES, _windows_sql, spans
from codeloom.sources.tables import Scratch

# ------------------------------------------------------------------------ call graph


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items call from supplier to part, all others from part to supplier."""
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    rows = table(spark, sf, "lineitem").select(
        F.when(back, supplier).otherwise(part).alias("source_id"),
        F.when(back, part).otherwise(supplier).alias("target_id"),
        "l_linenumber",
    )
    once = rows.groupBy("source_id", "target_id").agg(F.min("l_linenumber").alias("line"))
    return calls.call_edges(once)


_EDGES = """
    edge AS (SELECT source_id, target_id, min(l_linenumber) AS line FROM (
        SELECT CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS source_id,
               CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS target_id,
               l_linenumber FROM lineitem) GROUP BY ALL)"""


def methods(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("method_id"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("service_id"),
        F.col("s_name").alias("name"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("method_id"),
        F.col("p_brand").alias("service_id"),
        F.col("p_name").alias("name"),
    )
    return suppliers.unionByName(parts)


_METHODS = """
    method AS (SELECT 'S' || s_suppkey AS method_id, 'nation' || s_nationkey AS service_id, s_name AS name
               FROM supplier
               UNION ALL SELECT 'P' || p_partkey, p_brand, p_name FROM part)"""


@query(
    """
    WITH m AS (SELECT 'S' || s_suppkey AS id, s_name AS called FROM supplier
               UNION SELECT 'S' || s_suppkey, 'Sup.' || s_name FROM supplier),
    c AS (SELECT 'O' || l_orderkey AS caller, l_linenumber AS line,
            CASE WHEN l_linestatus = 'F' THEN 'Sup.' ELSE '' END || 'Supplier#' ||
            lpad(l_suppkey::VARCHAR, 9, '0') AS called FROM lineitem)
    SELECT caller AS source_id, id AS target_id, min(line)::BIGINT AS line
    FROM c JOIN m USING (called) GROUP BY ALL"""
)
def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    sites = table(spark, sf, "lineitem").select(
        F.lit("shop").alias("service_id"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("caller_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Sup."), name)).otherwise(name).alias("callee_name"),
        F.col("l_linenumber").alias("line"),
    )
    targets = table(spark, sf, "supplier").select(
        F.lit("shop").alias("service_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("method_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Sup."), "s_name").alias("full_name"),
    )
    resolved = calls.resolve_calls(sites, targets)
    return wide_ints(resolved.select("source_id", "target_id", "line"))


@query(
    f"""WITH {_EDGES}, {_METHODS}
    SELECT m.method_id, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM method m
    LEFT JOIN (SELECT target_id, count(*) AS n FROM edge JOIN method ON source_id = method_id GROUP BY 1) i
      ON i.target_id = m.method_id
    LEFT JOIN (SELECT source_id, count(*) AS n FROM edge GROUP BY 1) o ON o.source_id = m.method_id"""
)
def call_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(call_edges(spark, sf), methods(spark, sf))


@query(
    f"""WITH {_EDGES}, {_METHODS}
    SELECT target_id AS callee_id, method_id, service_id, name FROM edge JOIN method ON source_id = method_id"""
)
def callers(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.callers(call_edges(spark, sf), methods(spark, sf))
    return found.select("callee_id", "method_id", "service_id", "name")


@query(
    f"""WITH RECURSIVE {_EDGES},
    walk AS (SELECT 'S1' AS last, ['S1'] AS path
      UNION ALL SELECT e.target_id, list_append(w.path, e.target_id) FROM walk w JOIN edge e
        ON e.source_id = w.last WHERE len(w.path) < 4 AND w.last <> 'P5' AND NOT list_contains(w.path, e.target_id))
    SELECT array_to_string(path, '>') AS path FROM walk WHERE last = 'P5'"""
)
def call_paths(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark)  # stays: the result is read from it after this function returns
    edges = scratch.settle(call_edges(spark, sf).drop("metadata"), "edges")
    found = graph.call_paths(edges, "S1", "P5", 4, scratch.settle)
    return found.select(F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {_EDGES}, {_METHODS},
    seed AS (SELECT 'S' || s_suppkey AS id, s_acctbal / 10000 AS score FROM supplier
             ORDER BY s_acctbal DESC, s_suppkey LIMIT 24),
    nbr AS (SELECT target_id AS node, source_id AS nxt, 0.6::DOUBLE AS w FROM edge
            UNION ALL SELECT source_id, target_id, 0.5::DOUBLE FROM edge),
    a AS (SELECT nxt AS id, max(score * w) AS score FROM seed JOIN nbr ON node = id
          WHERE score * w >= 0.15::DOUBLE GROUP BY 1),
    b AS (SELECT nxt AS id, max(score * w) AS score FROM a JOIN nbr ON node = id
          WHERE score * w >= 0.15::DOUBLE GROUP BY 1)
    SELECT id AS method_id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
    WHERE id NOT IN (SELECT id FROM seed) GROUP BY 1"""
)
def expand_scored(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(24)
    seeds = best.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("method_id"),
        (F.col("s_acctbal") / 10000).alias("score"),
    )
    scratch = Scratch(spark)
    edges = scratch.settle(call_edges(spark, sf).drop("metadata"), "edges")
    spread = expansion.spread_scores(seeds, edges, methods(spark, sf), 2, settle=scratch.settle)
    return spread.select("method_id", F.round("score", 6).alias("score"))


@query(
    """
    SELECT 'O' || o_orderkey AS method_id, 'C' || o_custkey AS flow_id, c_name AS flow_name,
           left(o_orderpriority, 1)::BIGINT AS step, 'nation' || c_nationkey AS entry_method_id
    FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def flow_membership(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("target_id"),
        F.lit("flow_step").alias("kind"),
        F.create_map(F.lit("step"), F.substring("o_orderpriority", 1, 1)).alias("metadata"),
    )
    flows = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("flow_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("entry_method_id"),
    )
    return wide_ints(graph.flows_of_methods(steps, flows))


@query(
    f"""WITH {_EDGES}, {_METHODS}
    SELECT 'service' AS node_type, count(*) AS count FROM nation
    UNION ALL SELECT 'method', count(*) FROM method
    UNION ALL SELECT 'flow', count(*) FROM customer
    UNION ALL SELECT 'edge', count(*) FROM edge"""
)
def node_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_summary(
        service=table(spark, sf, "nation"),
        method=methods(spark, sf),
        flow=table(spark, sf, "customer"),
        edge=call_edges(spark, sf),
    )


@query(
    """
    SELECT 'nation' || n_nationkey AS service_id, count(s_suppkey) AS method_count
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"""
)
def method_counts(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("service_id")
    )
    return graph.methods_per_service(nations, methods(spark, sf))


@query(
    f"""WITH {_LINES}, {_windows_sql('c', 32, 24)}, {_windows_sql('m', 7, 7)},
    e AS (SELECT doc_id, block AS s, block + 7 AS t FROM m
          WHERE EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.block = m.block + 7)),
    p AS (SELECT c.doc_id, c.block AS chunk, m.block AS method, m.repo_id FROM c JOIN m
          ON c.doc_id = m.doc_id AND m.end_line >= c.start_line AND m.start_line <= c.end_line),
    f AS (SELECT p.*, (SELECT count(*) FROM e WHERE e.doc_id = p.doc_id AND e.t = p.method) AS i,
            (SELECT count(*) FROM e WHERE e.doc_id = p.doc_id AND e.s = p.method) AS o FROM p)
    SELECT doc_id || '::' || chunk AS chunk_id, sum(i)::BIGINT AS callers, sum(o)::BIGINT AS callees,
           'flow-' || min(repo_id) AS flow FROM f GROUP BY doc_id, chunk"""
)
def graph_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """Windows annotated with the calls of the seven-line methods they overlap; every method
    calls the next one of its file and is a step of its repository's flow."""
    hits = spans(spark, sf, 32, 8).select(
        F.concat_ws("::", "doc_id", "block").alias("chunk_id"),
        "repo_id",
        F.col("doc_id").cast("string").alias("file_path"),
        "start_line",
        "end_line",
    )
    scratch = Scratch(spark)  # stays: the result is read from it after this function returns
    small = scratch.settle(spans(spark, sf, 7, 0).drop("content"), "methods")
    own = F.concat_ws("::m", F.col("doc_id"), F.col("block"))
    method_rows = small.select(
        own.alias("method_id"),
        F.col("repo_id").alias("service_id"),
        F.col("doc_id").cast("string").alias("file_path"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
    )
    following = small.select(
        F.concat_ws("::m", F.col("doc_id"), F.col("block") - 7).alias("source_id"), own.alias("target_id")
    ).join(method_rows, F.col("source_id") == F.col("method_id"), "left_semi")
    no_note = F.create_map().cast("map<string,string>")
    call_rows = following.select("*", F.lit("method_call").alias("kind"), no_note.alias("metadata"))
    step_rows = small.select(
        F.concat(F.lit("f"), F.col("repo_id")).alias("source_id"),
        own.alias("target_id"),
        F.lit("flow_step").alias("kind"),
        no_note.alias("metadata"),
    )
    flows = small.select("repo_id").distinct().select(
        F.concat(F.lit("f"), "repo_id").alias("flow_id"),
        F.concat(F.lit("flow-"), "repo_id").alias("name"),
        F.lit("").alias("entry_method_id"),
    )
    return graph.annotate_hits(
        hits, method_rows, call_rows.unionByName(step_rows), flows, scratch.settle
    )


# ------------------------------------------------------------------- changes and upserts


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Last event per user and type, in the first twenty days and from the tenth to the end: all events."""
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("repo_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    seconds = (F.max("us") / 1000000).alias("mtime")

    def day(text: str) -> Column:
        return F.to_timestamp_ntz(F.lit(text))

    tracked = events.where(F.col("ts") < day("2024-01-20"))
    current = events.where(F.col("ts") >= day("2024-01-10"))
    return (
        tracked.groupBy("repo_id", "file_path").agg(seconds),
        current.groupBy("repo_id", "file_path").agg(seconds),
    )


_SNAPSHOTS = """
    ev AS (SELECT event_type AS repo_id, 'u' || user_id AS file_path, ts, epoch_us(ts) / 1000000 AS s FROM events),
    tracked AS (SELECT repo_id, file_path, max(s) AS mtime FROM ev WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
    cur AS (SELECT repo_id, file_path, max(s) AS mtime FROM ev
            WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2),
    diff AS (SELECT * FROM (SELECT coalesce(t.repo_id, c.repo_id) AS repo_id,
               coalesce(t.file_path, c.file_path) AS file_path,
               CASE WHEN t.mtime IS NULL THEN 'added' WHEN c.mtime IS NULL THEN 'deleted'
                 WHEN abs(c.mtime - t.mtime) > 0.001 THEN 'modified' END AS change_type
             FROM tracked t FULL JOIN cur c ON t.repo_id = c.repo_id AND t.file_path = c.file_path)
             WHERE change_type IS NOT NULL)"""


@query(f"WITH {_SNAPSHOTS} SELECT repo_id, file_path, change_type FROM diff")
def stale_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.file_changes(*_snapshots(spark, sf))


@query(
    f"""WITH {_SNAPSHOTS}
    SELECT count(*) FILTER (change_type = 'added') AS files_added,
           count(*) FILTER (change_type = 'modified') AS files_modified,
           count(*) FILTER (change_type = 'deleted') AS files_deleted,
           count(DISTINCT repo_id) AS repos_changed FROM diff"""
)
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changes.change_counts(changes.file_changes(*_snapshots(spark, sf)))


@query(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
               FROM events)
    SELECT user_id, event_id, event_type, round(value, 6) AS value FROM r WHERE n = 1"""
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Events applied one after another to a table keyed by user: the last one stays."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    empty = events.where(F.lit(False))
    state = keyed.upsert(empty, events, ["user_id"], "ts", "event_id")
    return state.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    doomed = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("o_custkey")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return keyed.delete_keys(orders, doomed, ["o_custkey"])


@query(
    """
    WITH r AS (SELECT 'S' || l_suppkey AS source_id, 'P' || l_partkey AS target_id,
                 CASE l_returnflag WHEN 'R' THEN 'db_write' ELSE 'db_read' END AS kind,
                 l_orderkey, l_linenumber, l_quantity FROM lineitem)
    SELECT source_id, target_id, kind, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_quantity)) AS l_orderkey,
           arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS l_quantity
    FROM r GROUP BY 1, 2, 3"""
)
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Edges keep the metadata of their last write."""
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_id"),
        F.when(F.col("l_returnflag") == "R", "db_write").otherwise("db_read").alias("kind"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
    )
    last = keyed.keep_last(
        rows, ["source_id", "target_id", "kind"], "l_orderkey", "l_linenumber", "l_quantity"
    )
    return last.select("source_id", "target_id", "kind", "l_orderkey", "l_quantity")


@query(
    f"""WITH {_METHODS},
    gone AS (SELECT 'nation' || n_nationkey AS id FROM nation WHERE n_regionkey = 1),
    e AS (SELECT service_id || '::' || method_id AS source_id, 'db:' || name AS target_id FROM method)
    SELECT 'method' AS part, method_id AS id FROM method WHERE service_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'service', 'nation' || n_nationkey FROM nation WHERE n_regionkey <> 1
    UNION ALL SELECT 'edge', source_id FROM e WHERE split_part(source_id, '::', 1) NOT IN (SELECT id FROM gone)"""
)
def delete_service(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation")
    name = F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"))
    rows = methods(spark, sf)
    edges = rows.select(
        F.concat_ws("::", "service_id", "method_id").alias("source_id"),
        F.concat(F.lit("db:"), "name").alias("target_id"),
    )
    doomed = nations.where(F.col("n_regionkey") == 1).select(name.alias("service_id"))
    left = keyed.delete_service(nations.select(name.alias("service_id")), rows, edges, doomed)
    return (
        left[1].select(F.lit("method").alias("part"), F.col("method_id").alias("id"))
        .unionByName(left[0].select(F.lit("service").alias("part"), F.col("service_id").alias("id")))
        .unionByName(left[2].select(F.lit("edge").alias("part"), F.col("source_id").alias("id")))
    )


# ----------------------------------------------------------------------- service graph


def order_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A small Python file per order that opens the store its priority stands for."""
    order = F.col("o_orderkey").cast("string")
    lines = F.array(
        F.when(F.col("o_orderpriority") == "1-URGENT", "r = redis.Redis('h')  # insert")
        .when(F.col("o_orderpriority") == "2-HIGH", "m = MongoClient('mongodb://h/shop?x=1')")
        .when(
            F.col("o_orderpriority") == "3-MEDIUM",
            F.concat(F.lit('c = psycopg2.connect("dbname=cust'), F.col("o_custkey").cast("string"), F.lit(' user=u")')),
        )
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "s = sqlite3.connect('data/o.db')")
        .otherwise(F.concat(F.lit("k = KafkaProducer(queue_name='a/q-"), "o_orderstatus", F.lit("')"))),
        F.when(F.col("o_orderstatus") == "O", "row.save(); send(row)")
        .when(F.col("o_orderstatus") == "F", 'row.find("insert insert")')
        .otherwise("select(row); update(row)"),
    )
    return spread_table(spark, sf, "orders").select(
        F.concat(F.lit("svc"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.concat(F.lit("app/o"), order, F.lit(".py")).alias("file_path"),
        F.lit("python").alias("service_language"),
        tx.join_lines(lines).alias("content"),
    )


_ORDER_FILES = r"""
    f AS (SELECT 'svc' || o_custkey AS repo_id, 'o' || o_orderkey || '.py' AS file,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'r = redis.Redis(''h'')  # insert'
        WHEN '2-HIGH' THEN 'm = MongoClient(''mongodb://h/shop?x=1'')'
        WHEN '3-MEDIUM' THEN 'c = psycopg2.connect("dbname=cust' || o_custkey || ' user=u")'
        WHEN '4-NOT SPECIFIED' THEN 's = sqlite3.connect(''data/o.db'')'
        ELSE 'k = KafkaProducer(queue_name=''a/q-' || o_orderstatus || ''')' END || chr(10) ||
      CASE o_orderstatus WHEN 'O' THEN 'row.save(); send(row)' WHEN 'F' THEN 'row.find("insert insert")'
        ELSE 'select(row); update(row)' END AS content FROM orders),
    b AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(content, '"[^"\n]*"', '""', 'g'),
            '''[^''\n]*''', '''''', 'g'), '#[^\n]*', '', 'g')) AS code FROM f),
    n AS (SELECT *, list_sum([len(string_split(code, w)) - 1 FOR w IN
              ['insert', 'update', '.save', '.create', 'publish', 'send']]) AS writes,
            list_sum([len(string_split(code, w)) - 1 FOR w IN
              ['select', 'find', '.get', 'query', 'receive', 'consume']]) AS reads FROM b)"""


@query(
    f"""WITH {_ORDER_FILES},
    h AS (SELECT n.*, p.kind AS db FROM n JOIN (VALUES ('redis.redis(', 'redis'), ('mongoclient(', 'mongodb'),
            ('psycopg2.connect', 'postgres'), ('sqlite3.connect', 'sqlite')) p(pat, kind) ON contains(code, pat))
    SELECT repo_id AS source_id, 'datastore:' || db || ':' || CASE db WHEN 'redis' THEN 'shared_redis_db'
        WHEN 'mongodb' THEN regexp_extract(content, '/(\\w+)\\?', 1)
        WHEN 'postgres' THEN regexp_extract(content, 'dbname=(\\w+)', 1) ELSE 'o.db' END AS target_id,
      CASE WHEN writes > reads THEN 'db_write' ELSE 'db_read' END AS kind, file FROM h"""
)
def datastore_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = services.datastore_edges(services.file_facts(order_sources(spark, sf)))
    return found.select("source_id", "target_id", "kind", F.col("metadata")["file"].alias("file"))


@query(
    f"""WITH {_ORDER_FILES}
    SELECT repo_id AS source_id, 'queue:kafka:' || regexp_extract(content, 'queue_name=''a/([^'']+)', 1) AS target_id,
      CASE WHEN writes > reads THEN 'queue_publish' ELSE 'queue_consume' END AS kind, file
    FROM n WHERE contains(code, 'kafkaproducer(')"""
)
def queue_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = services.queue_edges(services.file_facts(order_sources(spark, sf)))
    return found.select("source_id", "target_id", "kind", F.col("metadata")["file"].alias("file"))


_HOST = "regexp_extract(url, 'https?://([^/?#:]+)', 1)"


@query(
    f"""
    WITH p AS (SELECT page_id, {_HOST} AS host FROM pages),
    svc AS (SELECT DISTINCT split_part(host, '.', 1) AS id FROM p WHERE host NOT LIKE 'www.%'),
    own AS (SELECT page_id, host, 'page' || page_id AS repo_id FROM p)
    SELECT DISTINCT repo_id AS source_id, id AS target_id, host AS url FROM own JOIN svc
    ON contains(lower(replace(replace(host, '-', ''), '_', '')), lower(replace(replace(id, '-', ''), '_', '')))"""
)
def url_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every page fetches its own address; the first labels of the hosts are services."""
    pages = table(spark, sf, "pages")
    files = pages.select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("repo_id"),
        F.lit("client.py").alias("file_path"),
        F.concat(F.lit('requests.get("'), "url", F.lit('")')).alias("content"),
        F.lit("python").alias("service_language"),
    )
    host = F.regexp_extract("url", r"https?://([^/?#:]+)", 1)
    named = pages.where(~host.startswith("www.")).select(
        F.substring_index(host, ".", 1).alias("service_id")
    ).distinct()
    found = services.url_edges(services.file_facts(files), named)
    return found.select("source_id", "target_id", F.col("metadata")["url"].alias("url"))


@query(
    r"""
    WITH v AS (SELECT 'order' || o_orderkey AS repo_id,
        CASE o_orderstatus WHEN 'O' THEN upper(replace(c_mktsegment, ' ', '_')) || '_API_URL'
          WHEN 'F' THEN 'NATION_' || c_nationkey || '_HOST' ELSE '_API_URL' END AS variable
      FROM orders JOIN customer ON c_custkey = o_custkey),
    b AS (SELECT DISTINCT repo_id, variable, lower(replace(replace(replace(replace(variable, '_URL', ''), '_HOST', ''),
        '_API', ''), '_', '')) AS bare FROM v),
    s AS (SELECT lower(n_name) AS id, lower(replace(n_name, '_', '')) AS slug FROM nation
          UNION SELECT lower(c_mktsegment) || '-app', lower(c_mktsegment) || 'app' FROM customer),
    m AS (SELECT bare, min(id) AS id FROM (SELECT DISTINCT bare FROM b) d JOIN s
          ON contains(bare, slug) OR contains(slug, bare) GROUP BY 1)
    SELECT repo_id, variable, coalesce(id, 'external:env_url') AS target_id FROM b LEFT JOIN m USING (bare)"""
)
def env_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read the address of their customer's segment or nation from the environment."""
    customers = table(spark, sf, "customer")
    joined = table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    variable = (
        F.when(
            F.col("o_orderstatus") == "O",
            F.concat(F.upper(F.replace("c_mktsegment", F.lit(" "), F.lit("_"))), F.lit("_API_URL")),
        )
        .when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("_HOST")),
        )
        .otherwise("_API_URL")
    )
    reads = joined.select(
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("repo_id"),
        variable.alias("variable"),
    )
    named = table(spark, sf, "nation").select(F.lower("n_name").alias("service_id")).unionByName(
        customers.select(F.concat(F.lower("c_mktsegment"), F.lit("-app")).alias("service_id")).distinct()
    )
    return services.env_targets(reads, named)


@query(
    """
    WITH n AS (SELECT p_brand AS svc, unnest([p_type, 'job' || p_partkey || '.py', 'job' || p_partkey]) AS name FROM part),
    c AS (SELECT DISTINCT 'Brand#' || (1 + l_suppkey % 25) AS repo_id, 'job' || l_partkey AS name, l_orderkey FROM lineitem),
    t AS (SELECT c.repo_id, c.name, c.l_orderkey, min(n.svc) AS target FROM c JOIN n ON n.name = c.name AND n.svc <> c.repo_id
          GROUP BY ALL)
    SELECT repo_id AS source_id, target AS target_id, name AS rpc_method, 'o' || l_orderkey || '.ts' AS file FROM t"""
)
def rpc_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items call a job by name; the brand of the part hosts the job's file."""
    brand = F.concat(F.lit("Brand#"), (1 + F.col("l_suppkey") % 25).cast("string"))
    files = spread_table(spark, sf, "lineitem").select(
        brand.alias("repo_id"),
        F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file_path"),
        F.concat(
            F.lit("await sb.functions.invoke('job"), F.col("l_partkey").cast("string"),
            F.lit("', {}); fetch(process.env.X)"),
        ).alias("content"),
        F.lit("typescript").alias("service_language"),
    ).distinct()
    hosted = table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.concat("p_type", F.lit("/job"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"),
    )
    found = services.rpc_edges(services.file_facts(files), hosted)
    note = F.col("metadata")
    return found.select(
        "source_id", "target_id", note["rpc_method"].alias("rpc_method"), note["file"].alias("file")
    )


@query(
    """
    WITH c AS (SELECT DISTINCT 'team' || l_suppkey % 60 AS repo_id, 'job' || l_partkey AS name,
            'o' || l_orderkey || '.ts' AS file FROM lineitem),
    h AS (SELECT min(p_brand) AS target, 'job' || p_partkey AS name FROM part GROUP BY ALL),
    e AS (SELECT repo_id AS source_id, target AS target_id, name, '{"rpc_method":"' || name || '","file":"' || file AS note
          FROM c JOIN h USING (name))
    SELECT source_id, target_id, arg_max(name, note) AS rpc_method FROM e GROUP BY ALL"""
)
def incremental_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Teams call jobs that brands host. Some brands lose old jobs and gain new ones after the first
    linking; the edges kept current must be those of linking everything."""
    team = F.concat(F.lit("team"), (F.col("l_suppkey") % 60).cast("string"))
    files = table(spark, sf, "lineitem").select(
        team.alias("repo_id"),
        F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file_path"),
        F.concat(
            F.lit("await sb.functions.invoke('job"), F.col("l_partkey").cast("string"),
            F.lit("', {}); fetch(process.env.X)"),
        ).alias("content"),
        F.lit("typescript").alias("service_language"),
    ).distinct()
    scratch = Scratch(spark)
    facts = scratch.settle(services.file_facts(files), "facts")
    part = table(spark, sf, "part")
    job = lambda kind: F.concat(kind, F.lit("/job"), F.col("p_partkey").cast("string"), F.lit(".py"))
    hosted = part.select(F.col("p_brand").alias("repo_id"), job(F.col("p_type")).alias("file_path"))
    moves = (F.col("p_size") < 5) & (F.substring("p_brand", 7, 1) == "1")
    at_first = part.where(~moves).select(F.col("p_brand").alias("repo_id"), job(F.col("p_type")).alias("file_path"))
    withdrawn = part.where(moves).select(
        F.concat(F.lit("Brand#1"), (F.col("p_partkey") % 3).cast("string")).alias("repo_id"), job(F.lit("old")).alias("file_path")
    )
    before = at_first.unionByName(withdrawn)
    owned = facts.select("repo_id").unionByName(hosted.select("repo_id")).distinct().select(F.col("repo_id").alias("service_id"))
    owned = scratch.settle(owned, "services")
    edges = scratch.settle(services.link(facts, owned, before)[1], "edges")

    changed = linking.differing(before, hosted).select("repo_id").distinct()
    names = linking.changed_names(*(p.join(changed, "repo_id", "left_semi") for p in (before, hosted)))
    reached = scratch.settle(linking.affected_repos(changed, facts, owned.limit(0), names), "reached")
    anew = services.link(facts.join(reached, "repo_id", "left_semi"), owned, hosted)[1]
    kept = edges.join(reached.select(F.col("repo_id").alias("source_id")), "source_id", "left_anti")
    now = kept.unionByName(anew).where(F.col("kind") == "rpc_call")
    return now.select("source_id", "target_id", F.col("metadata")["rpc_method"].alias("rpc_method"))


@query(
    """
    WITH s AS (SELECT lower(replace(p_type, ' ', '_')) || '_kit' AS id FROM part GROUP BY 1),
    nm AS (SELECT id, id AS name FROM s UNION SELECT id, replace(id, '_', '-') FROM s),
    f AS (SELECT 'proj' || p_partkey AS repo_id, lower(replace(p_type, ' ', '_')) AS t, p_size FROM part),
    m AS (SELECT repo_id, CASE WHEN p_size < 20 THEN '{"' || replace(t, '_', '-') || '-kit": "1"}'
            ELSE 'flask ' || t || '_kit==2' END AS content FROM f),
    i AS (SELECT repo_id, CASE WHEN p_size < 30 THEN 'from ' || t || '_kit.core import x'
            ELSE 'x = require("@org/' || replace(t, '_', '-') || '-kit")' END AS content FROM f)
    SELECT DISTINCT repo_id AS source_id, id AS target_id, 'manifest dependency' AS note FROM m JOIN nm
      ON contains(content, '"' || name || '"') OR contains(content, ' ' || name || '==')
    UNION ALL
    SELECT DISTINCT repo_id, id, 'source import' FROM i JOIN nm
      ON contains(content, 'from ' || replace(name, '-', '_')) OR contains(content, 'import ' || replace(name, '-', '_'))
         OR regexp_matches(content, '(import|require).*' || name)"""
)
def library_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest and a source per part, both naming the kit of the part's type."""
    kind = F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))
    dashed = F.replace(kind, F.lit("_"), F.lit("-"))
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("proj"), F.col("p_partkey").cast("string")).alias("repo_id"),
        kind.alias("kind"), dashed.alias("dashed"), "p_size",
    )
    manifest = F.when(
        F.col("p_size") < 20, F.concat(F.lit('{"'), "dashed", F.lit('-kit": "1"}'))
    ).otherwise(F.concat(F.lit("flask "), "kind", F.lit("_kit==2")))
    code = F.when(
        F.col("p_size") < 30, F.concat(F.lit("from "), "kind", F.lit("_kit.core import x"))
    ).otherwise(F.concat(F.lit('x = require("@org/'), "dashed", F.lit('-kit")')))
    named = parts.select(F.concat("kind", F.lit("_kit")).alias("service_id")).distinct()
    python = F.lit("python").alias("service_language")
    manifests = parts.select("repo_id", F.lit("requirements.txt").alias("file_path"), manifest.alias("content"), python)
    sources = parts.select("repo_id", F.lit("src/main.py").alias("file_path"), code.alias("content"), python)
    found = services.manifest_edges(services.file_facts(manifests), named).unionByName(
        services.import_edges(services.file_facts(sources), named)
    )
    return found.select("source_id", "target_id", F.col("metadata")["note"].alias("note"))


@query(
    """
    SELECT 'proj' || p_partkey AS service_id,
           CASE WHEN (p_size < 10 AND p_type IN ('SMALL', 'LARGE')) OR p_size > 45 THEN 'infrastructure'
                ELSE 'service' END AS service_type FROM part"""
)
def service_types(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("proj"), F.col("p_partkey").cast("string")).alias("repo_id"), "p_size", "p_type"
    )
    small = F.col("p_size") < 10
    manifests = parts.select(
        "repo_id",
        F.when(F.col("p_type") == "SMALL", "python").when(F.col("p_type") == "LARGE", "typescript").otherwise("java")
        .alias("service_language"),
        F.when(F.col("p_type") == "SMALL", "requirements.txt").otherwise("package.json").alias("file_path"),
        F.when(small, "pulumi aws-cdk-lib").otherwise("flask express").alias("content"),
    )
    terraform = parts.select(
        "repo_id",
        F.lit("java").alias("service_language"),
        F.when(F.col("p_size") > 45, "infra/main.tf").otherwise("src/Main.java").alias("file_path"),
        F.lit("x").alias("content"),
    )
    return services.service_types(manifests.unionByName(terraform))


# -------------------------------------------------------------------------- exports


def _graph_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nations are services, brands datastores, segments queues; suppliers write and customers read."""
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("svc-"), "n_name").alias("service_id"), F.col("n_name").alias("name"),
        F.lit("go").alias("language"), F.array(F.lit("t")).alias("tags"), F.lit("service").alias("service_type"),
        "n_nationkey",
    )
    brands = table(spark, sf, "part").select("p_brand").distinct().select(
        F.concat(F.lit("datastore:postgres:"), "p_brand").alias("node_id"),
        F.lit("datastore").alias("node_type"), F.lit("postgres").alias("kind"), F.col("p_brand").alias("name"),
    )
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct().select(
        F.concat(F.lit("queue:kafka:"), "c_mktsegment").alias("node_id"),
        F.lit("queue").alias("node_type"), F.lit("kafka").alias("kind"), F.col("c_mktsegment").alias("name"),
    )
    publish = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("service_id").alias("source_id"),
        F.concat(F.lit("queue:kafka:"), "c_mktsegment").alias("target_id"),
        F.when(F.col("c_acctbal") < 0, "queue_publish").otherwise("queue_consume").alias("kind"),
    )
    internal = call_edges(spark, sf).select("source_id", "target_id", "kind")
    edges = publish.unionByName(internal).withColumn(
        "metadata", F.create_map(F.lit("file"), F.lit("a.go"))
    )
    return nations.drop("n_nationkey"), brands.unionByName(segments), edges, nations


_EXPORT_EDGES = """
    e AS (SELECT DISTINCT 'svc-' || n_name AS s, 'queue:kafka:' || c_mktsegment AS t,
            CASE WHEN c_acctbal < 0 THEN 'queue_publish' ELSE 'queue_consume' END AS kind
          FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    f"""WITH {_EXPORT_EDGES},
    n AS (SELECT 'svc_' || n_name AS id, n_name AS label, 1 AS k FROM nation
          UNION ALL SELECT DISTINCT 'datastore_postgres_' || p_brand, p_brand, 2 FROM part
          UNION ALL SELECT DISTINCT 'queue_kafka_' || c_mktsegment, c_mktsegment, 3 FROM customer)
    SELECT 0::BIGINT AS section, 'graph LR' AS line
    UNION ALL SELECT 10, '  %% Services' UNION ALL SELECT 20, '  %% Data Stores' UNION ALL SELECT 30, '  %% Queues'
    UNION ALL SELECT 10 * k + 1, '  ' || id || CASE k WHEN 1 THEN '["' || label || '"]' WHEN 2 THEN '[("' || label || '")]'
        ELSE '>"' || label || '"]' END FROM n
    UNION ALL SELECT 40, '  %% Edges'
    UNION ALL SELECT 41, '  ' || replace(s, '-', '_') || CASE kind WHEN 'queue_publish' THEN ' -- Publishes --> '
        ELSE ' -- Consumes --> ' END || replace(t, ':', '_') FROM e
    UNION ALL SELECT 50, '  %% Styling'
    UNION ALL SELECT 50, '  classDef ' || c || ' fill:#161b22,stroke:' || f || ',stroke-width:2px,color:#c9d1d9;' FROM
        (VALUES ('service', '#39d353'), ('datastore', '#ffa657'), ('queue', '#bc8cff')) v(c, f)
    UNION ALL SELECT 60 + k, '  class ' || id || CASE k WHEN 1 THEN ' service' WHEN 2 THEN ' datastore' ELSE ' queue' END
        FROM n"""
)
def mermaid_export(spark: SparkSession, sf: str) -> DataFrame:
    nations, resources, edges, _ = _graph_nodes(spark, sf)
    nodes = nations.select(
        F.col("service_id").alias("node_id"), F.lit("service").alias("node_type"), "name"
    ).unionByName(resources.select("node_id", "node_type", "name"))
    return wide_ints(exports.mermaid_lines(nodes, edges).select("section", "line"))


@query(
    f"""WITH {_EXPORT_EDGES},
    c AS (SELECT 'svc-' || n_name AS id, n_name, count(s_suppkey) AS m FROM nation
          LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)
    SELECT 'nodes' AS part, '{{"id":"' || id || '","type":"service","label":"' || n_name
        || '","language":"go","service_type":"service","tags":["t"],"method_count":' || m || '}}' AS object FROM c
    UNION ALL SELECT DISTINCT 'nodes', '{{"id":"datastore:postgres:' || p_brand || '","type":"datastore","label":"' || p_brand
        || '","kind":"postgres"}}' FROM part
    UNION ALL SELECT DISTINCT 'nodes', '{{"id":"queue:kafka:' || c_mktsegment || '","type":"queue","label":"' || c_mktsegment
        || '","kind":"kafka"}}' FROM customer
    UNION ALL SELECT 'nodes', '{{"id":"flow' || r_regionkey || '","type":"flow","label":"' || r_name
        || '","service_id":"svc-NATION_' || r_regionkey || '","step_count":' || r_regionkey || '}}' FROM region
    UNION ALL SELECT 'edges', '{{"source":"' || s || '","target":"' || t || '","kind":"' || kind
        || '","meta":{{"file":"a.go"}}}}' FROM e
    UNION ALL SELECT 'edges', '{{"source":"svc-NATION_' || r_regionkey || '","target":"flow' || r_regionkey
        || '","kind":"flow_link","meta":{{}}}}' FROM region"""
)
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    nations, resources, edges, keyed_nations = _graph_nodes(spark, sf)
    owners = table(spark, sf, "supplier").join(
        keyed_nations, F.col("s_nationkey") == F.col("n_nationkey")
    ).select("service_id", F.col("s_suppkey").cast("string").alias("method_id"))
    flows = table(spark, sf, "region").select(
        F.concat(F.lit("flow"), F.col("r_regionkey").cast("string")).alias("flow_id"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("svc-NATION_"), F.col("r_regionkey").cast("string")).alias("service_id"),
        F.lit("").alias("entry_method_id"),
        F.col("r_regionkey").alias("step_count"),
    )
    return exports.json_objects(nations, resources, flows, owners, edges).select("part", "object")


# -------------------------------------------------------------------------- parsing


def _code(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def python_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A Python module per part: a class with one method, a function and a test."""
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    body = F.repeat(F.lit("        total += 1\n"), size)
    return spread_table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        _code("lib/part", key, ".py").alias("file_path"),
        F.lit("python").alias("language"),
        "p_partkey",
        "p_size",
        _code(
            "class Part", key, ":\n    def price(self, total):\n", body,
            "        return self.tax(total)\n\ndef load_", key, "(a, b):\n    return Part", key,
            "().price(a)\n\ndef test_load():\n    load_", key, "(1, 2)\n",
        ).alias("content"),
    )


@query(
    """
    WITH p AS (SELECT p_brand AS svc, 'lib/part' || p_partkey || '.py' AS f, p_partkey AS k, p_size::BIGINT AS n FROM part)
    SELECT svc || '::' || f || '::Part' || k || '.price' AS method_id, 'price' AS name, 'Part' || k AS class_name,
           'def price(self, total)' AS signature, 2::BIGINT AS line_start, n + 3 AS line_end FROM p
    UNION ALL SELECT svc || '::' || f || '::load_' || k, 'load_' || k, NULL, 'def load_' || k || '(a, b)', n + 5, n + 6 FROM p"""
)
def python_methods(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = definitions.parsed_methods_and_calls(
        definitions.with_parser(python_sources(spark, sf))
    )
    return wide_ints(found.select("method_id", "name", "class_name", "signature", "line_start", "line_end"))


@query(
    """
    WITH p AS (SELECT p_brand || '::lib/part' || p_partkey || '.py::' AS f, p_partkey AS k, p_size::BIGINT AS n FROM part)
    SELECT f || 'Part' || k || '.price' AS caller_id, 'tax' AS callee_name, n + 3 AS line FROM p
    UNION ALL SELECT f || 'load_' || k, 'Part' || k, n + 6 FROM p
    UNION ALL SELECT f || 'load_' || k, 'price', n + 6 FROM p"""
)
def python_calls(spark: SparkSession, sf: str) -> DataFrame:
    _, found = definitions.parsed_methods_and_calls(
        definitions.with_parser(python_sources(spark, sf))
    )
    return wide_ints(found.select("caller_id", "callee_name", "line"))


@query(
    """
    WITH p AS (SELECT p_brand || '::lib/part' || p_partkey || '.py::' AS f, p_partkey AS k, p_size::BIGINT AS n FROM part)
    SELECT f || 'Part' || k AS chunk_id, 'class' AS chunk_type, 1::BIGINT AS start_line, n + 3 AS end_line FROM p
    UNION ALL SELECT f || 'Part' || k || '.price', 'method', 2, n + 3 FROM p
    UNION ALL SELECT f || 'load_' || k, 'function', n + 5, n + 6 FROM p
    UNION ALL SELECT f || 'test_load', 'function', n + 8, n + 9 FROM p"""
)
def python_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.extract_chunks(python_sources(spark, sf))
    return wide_ints(chunks.select("chunk_id", "chunk_type", "start_line", "end_line"))


def scripted_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A file per part in the language its type stands for, with a body as long as the part's size."""
    key = F.col("p_partkey").cast("string")
    filler = F.repeat(F.lit('  if (x) { y("}"); } // {\n'), F.col("p_size"))
    ruby_filler = F.repeat(F.lit("    if a # end\n    end\n"), F.col("p_size"))
    kind = F.col("p_type")
    content = (
        F.when(kind == "STANDARD", _code("package x\n\nfunc Load", key, "(a int) {\n", filler, "}\n"))
        .when(kind == "MEDIUM", _code("class S", key, " {\n  run(a) {\n", filler, "  }\n}\nexport const f", key, " = (a) => {\n}\n"))
        .when(kind == "PROMO", _code("public class J {\n  public int load", key, "(int a)\n  {\n", filler, "  }\n}\n"))
        .when(kind == "SMALL", _code("pub fn load_", key, "(a: u8) -> u8 {\n", filler, "}\nfn test_x() {\n}\n"))
        .when(kind == "LARGE", _code("class R\n  def load_", key, "(a)\n", ruby_filler, "  end\nend\n"))
        .otherwise(_code("struct C {\n  int size() const {\n", filler, "    return mine(1);\n  }\n};\nint C::mine(int a)\n{\n  return a;\n}\n"))
    )
    suffix = (
        F.when(kind == "STANDARD", ".go").when(kind == "MEDIUM", ".ts").when(kind == "PROMO", ".java")
        .when(kind == "SMALL", ".rs").when(kind == "LARGE", ".rb").otherwise(".cpp")
    )
    return spread_table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"), _code("src/p", key, suffix).alias("file_path"), content.alias("content")
    )


_SCRIPTED = """
    p AS (SELECT p_brand || '::src/p' || p_partkey AS f, p_partkey AS k, p_size::BIGINT AS n, p_type AS t FROM part)"""


@query(
    f"""WITH {_SCRIPTED}
    SELECT f || '.go::Load' || k AS method_id, 3::BIGINT AS line_start, n + 4 AS line_end FROM p WHERE t = 'STANDARD'
    UNION ALL SELECT f || '.ts::S' || k || '.run', 2, n + 3 FROM p WHERE t = 'MEDIUM'
    UNION ALL SELECT f || '.ts::f' || k, n + 5, n + 6 FROM p WHERE t = 'MEDIUM'
    UNION ALL SELECT f || '.java::load' || k, 2, n + 4 FROM p WHERE t = 'PROMO'
    UNION ALL SELECT f || '.rs::load_' || k, 1, n + 2 FROM p WHERE t = 'SMALL'
    UNION ALL SELECT f || '.rb::load_' || k, 2, 2 * n + 3 FROM p WHERE t = 'LARGE'
    UNION ALL SELECT f || '.cpp::C.size', 2, n + 4 FROM p WHERE t = 'ECONOMY'
    UNION ALL SELECT f || '.cpp::C.mine', n + 6, n + 9 FROM p WHERE t = 'ECONOMY'"""
)
def script_methods(spark: SparkSession, sf: str) -> DataFrame:
    found = definitions.scripted_methods(definitions.with_parser(scripted_sources(spark, sf)))
    return wide_ints(found.select("method_id", "line_start", "line_end"))


@query(
    f"""WITH {_SCRIPTED}
    SELECT f || '.cpp::C.size' AS caller_id, c AS callee_name, l AS line FROM p,
      LATERAL (SELECT 'size' AS c, 2::BIGINT AS l UNION ALL SELECT 'mine', n + 3
               UNION ALL SELECT 'y', unnest(range(3, n + 3))) WHERE t = 'ECONOMY'
    UNION ALL SELECT f || '.cpp::C.mine', 'mine', n + 6 FROM p WHERE t = 'ECONOMY'"""
)
def cpp_calls(spark: SparkSession, sf: str) -> DataFrame:
    files = definitions.with_parser(scripted_sources(spark, sf)).where(F.col("parser") == "cpp")
    found = definitions.cpp_calls(files, definitions.scripted_methods(files))
    return wide_ints(found.select("caller_id", "callee_name", "line"))


@query(
    f"""WITH {_SCRIPTED},
    c AS (SELECT f || CASE t WHEN 'STANDARD' THEN '.go::Load' || k WHEN 'MEDIUM' THEN '.ts::S' || k || '.run'
                      WHEN 'PROMO' THEN '.java::load' || k ELSE '.rs::load_' || k END AS caller_id,
                 n, CASE t WHEN 'MEDIUM' THEN 3 WHEN 'SMALL' THEN 2 ELSE 4 END AS first
          FROM p WHERE t IN ('STANDARD', 'MEDIUM', 'PROMO', 'SMALL'))
    SELECT caller_id, 'y' AS callee_name, unnest(range(first, first + n)) AS line FROM c"""
)
def script_calls(spark: SparkSession, sf: str) -> DataFrame:
    files = definitions.with_parser(scripted_sources(spark, sf))
    found = definitions.script_calls(files, definitions.scripted_methods(files))
    return wide_ints(found.select("caller_id", "callee_name", "line"))
