"""Fact tables derived from the supplied tables, in SQL that Spark and DuckDB both run.

Each adapter is a SELECT over ``{table}`` placeholders. ``frame`` runs it in
Spark over whole tables; ``sql`` gives the same text for any other engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Findings: one for each event. Nullable attributes are null for some events, since null means unknown.
FINDINGS = """
SELECT event_id AS ord, concat('crate', user_id) AS crate,
  CASE event_type WHEN 'click' THEN 'network' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'process_exec'
    WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'env_access' WHEN event_id % 3 = 1 THEN 'file_write' ELSE 'proc_macro' END ELSE 'crypto' END AS capability,
  concat('src/m', event_id % 7, '/f', user_id % 5, '.rs') AS file, CAST(event_id AS INT) AS line, CAST(1 + event_id % 80 AS INT) AS col,
  props AS evidence,
  CASE event_id % 6 WHEN 0 THEN 'import' WHEN 1 THEN 'string_literal' WHEN 2 THEN 'attribute' WHEN 3 THEN 'code_site' WHEN 4 THEN 'manifest_hook' END AS origin,
  CASE event_id % 5 WHEN 1 THEN 'python' WHEN 2 THEN 'java_script' WHEN 3 THEN 'go' WHEN 4 THEN 'bash' END AS language,
  CASE event_id % 4 WHEN 0 THEN 'runtime' WHEN 1 THEN 'build_hook' WHEN 2 THEN 'install_hook' END AS execution_context,
  CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS reachable
FROM {events}"""

# Data flows: one for each order, by customer.
FLOWS = """
SELECT o_orderkey AS ord, concat('crate', o_custkey % 1000) AS crate,
  CASE o_orderkey % 13 WHEN 0 THEN 'taint-flow' WHEN 1 THEN 'dead-store' WHEN 2 THEN 'discarded-result' WHEN 3 THEN 'partial-error-handling' WHEN 4 THEN 'repeated-call' WHEN 5 THEN 'unnecessary-clone'
    WHEN 6 THEN 'allocation-in-loop' WHEN 7 THEN 'redundant-collect' WHEN 8 THEN 'lock-across-await' WHEN 9 THEN 'inconsistent-lock-order' WHEN 10 THEN 'immutable-growable' WHEN 11 THEN 'swallowed-ok' ELSE 'unobserved-spawn' END AS kind,
  CASE WHEN o_orderkey % 13 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'env_access' WHEN 1 THEN 'file_read' ELSE 'network' END END AS source_capability,
  CASE WHEN o_orderkey % 13 = 0 THEN CASE o_orderkey % 2 WHEN 0 THEN 'network' ELSE 'process_exec' END END AS sink_capability
FROM {orders}"""

# A directed graph with a containment tree: regions hold nations, nations hold customers (functions) and suppliers (types).
NODES = """
SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'container' AS category, r_name AS label FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 'container', n_name FROM {nation}
UNION ALL SELECT 1000 + 2 * c_custkey, CAST(100 + c_nationkey AS BIGINT), 'function', c_name FROM {customer}
UNION ALL SELECT 1001 + 2 * s_suppkey, CAST(100 + s_nationkey AS BIGINT), 'type', s_name FROM {supplier}"""
EDGES = """
SELECT l_orderkey * 16 + l_linenumber AS id,
  CASE WHEN l_returnflag = 'R' THEN 1001 + 2 * l_suppkey ELSE 1000 + 2 * o_custkey END AS src,
  CASE WHEN l_returnflag = 'R' THEN 1000 + 2 * o_custkey ELSE 1001 + 2 * l_suppkey END AS dst,
  CASE l_linenumber % 5 WHEN 0 THEN 'call' WHEN 1 THEN 'import' WHEN 2 THEN 'implementation' WHEN 3 THEN 'reference' ELSE 'depends_on' END AS kind,
  CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'possible' END AS certainty
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

# A small graph of nations: each ships to the nation of the supplier it buys most from, by year.
NATION_EDGES = """
SELECT CAST(row_number() OVER (ORDER BY src, dst) AS BIGINT) AS id, src, dst, 'call' AS kind, 'resolved' AS certainty FROM (
  SELECT DISTINCT src, dst FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src, yr ORDER BY n DESC, dst) AS place FROM (
      SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, year(o_orderdate) AS yr, count(*) AS n
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
      GROUP BY c_nationkey, s_nationkey, year(o_orderdate)) a) b WHERE place = 1) c"""
NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'function' AS category, n_name AS label FROM {nation}"

# Functions and what happens in them: an order is a function, its lines are statements.
FUNCTIONS = """
SELECT o_orderkey AS fn, concat('src/c', o_custkey, '.rs') AS file, concat('f', o_orderkey) AS name, CAST(o_orderkey % 500 AS INT) AS line, CAST(o_orderkey % 80 AS INT) AS col,
  CAST(o_custkey % 9 AS INT) AS params, CAST(floor(o_totalprice / 2000) AS INT) AS body_lines, concat('T', o_custkey % 50) AS method_of, o_orderpriority = '5-LOW' AS forwarder,
  o_orderstatus = 'F' AS is_async, o_orderpriority = '1-URGENT' AS arithmetic
FROM {orders}"""
STATEMENTS = """
SELECT l_orderkey AS fn, l_linenumber AS stmt, concat('src/c', o_custkey, '.rs') AS file, l_orderkey * 16 + l_linenumber AS ord,
  concat('v', l_partkey % 3) AS var, concat('m', l_suppkey % 4) AS callee, concat('a', l_partkey % 2) AS args,
  CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' ELSE 'call' END AS access,
  CASE l_linenumber % 6 WHEN 0 THEN 'if' WHEN 1 THEN 'match' WHEN 2 THEN 'for' WHEN 3 THEN 'while' WHEN 4 THEN 'loop' ELSE 'closure' END AS kind,
  CASE l_suppkey % 3 WHEN 0 THEN 'if' WHEN 1 THEN 'match' END AS parent_branch,
  CAST(l_quantity AS INT) % 7 AS depth, CAST(round(l_discount * 100) AS INT) % 3 AS loop_depth, CAST(l_quantity AS INT) % 5 AS chain_len, l_linestatus = 'O' AS flag,
  CAST(l_orderkey % 500 AS INT) AS line, CAST(l_linenumber AS INT) AS col
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

# Source files: documents by language, pages and conversation turns.
FILES = """
SELECT concat('docs/', source, '/', doc_id, '.', CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'go' ELSE 'sh' END) AS path, text AS source FROM {documents}
UNION ALL SELECT concat('pages/', page_id, '.ts'), html FROM {pages}
UNION ALL SELECT concat('turns/', conv_id, '/', turn, '/', CASE role WHEN 'user' THEN 'Makefile' ELSE 'notes.txt' END), text FROM {conversations}"""
FINGERPRINTS = """
SELECT source AS crate, concat(lang, '/', doc_id) AS file, doc_id AS fn, concat(length(text) - length(replace(text, chr(10), '')), ':', n_chars) AS skeleton, md5(text) AS exact,
  CAST(n_chars AS INT) AS fact_count FROM {documents}"""

# Attested packages: a brand is a crate; its sizes are versions.
ATTESTATIONS = """
SELECT p_brand AS name, concat('1.', CAST((p_size - p_size % 7) / 7 AS INT), '.', p_size % 7) AS version, p_partkey AS ord,
  CASE p_type WHEN 'ECONOMY' THEN 'network' WHEN 'STANDARD' THEN 'crypto' WHEN 'PROMO' THEN 'ffi' ELSE 'file_read' END AS capability, p_name AS evidence, p_size % 11 AS skipped
FROM {part}"""


def tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an adapter over the whole tables of ``sf_dir``."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(text)})


def sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
