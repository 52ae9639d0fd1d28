"""Corpora of files and graphs that both engines derive from the test tables by the same SQL.

``D_FILES`` turns documents into files: folders by source and language, names by id, every tenth a test, and now and then
an entrypoint, a readme or a project file. ``D_TRADE`` is a graph of nations by traded value. ``D_EDGES`` links files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

D_FILES = """
SELECT doc_id, bytes AS size_bytes, n_chars AS chars, doc_id * 1000 AS mtime_ns,
  source || '/' || lang || CASE WHEN doc_id % 10 >= 8 THEN '/sub' ELSE '' END || CASE WHEN doc_id % 25 = 7 THEN '/app' || CAST(doc_id AS VARCHAR(20)) ELSE '' END || '/' ||
  CASE WHEN doc_id % 75 = 7 THEN 'main.py' WHEN doc_id % 75 = 32 THEN 'README.md' WHEN doc_id % 75 = 57 THEN 'pyproject.toml'
    ELSE CASE WHEN doc_id % 10 = 3 THEN 'test_m' ELSE 'm' END || CAST(CAST(floor(doc_id / 10) AS BIGINT) AS VARCHAR(20)) ||
      CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' WHEN 3 THEN '.go' WHEN 4 THEN '.md' WHEN 5 THEN '.toml' WHEN 6 THEN '.json' ELSE '.java' END END AS path
FROM (SELECT doc_id, source, lang, n_chars, {bytes} AS bytes FROM documents) d
"""

#: With the kind, language and category of the classification, for queries that build on it.
D_CLASSIFIED = f"""
SELECT doc_id, path, size_bytes, chars, mtime_ns, name,
  CASE WHEN suffix IN ('.py', '.ts', '.rs', '.go', '.java') THEN 'code' ELSE 'support' END AS kind,
  CASE suffix WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.toml' THEN 'toml' WHEN '.json' THEN 'json' ELSE 'markdown' END AS language,
  CASE WHEN suffix IN ('.py', '.ts', '.rs', '.go', '.java') THEN NULL WHEN suffix = '.toml' THEN 'project config' WHEN name = 'README.md' THEN 'documentation' ELSE 'support file' END AS support_category,
  CASE WHEN suffix IN ('.toml', '.json') OR name = 'README.md' THEN 'full' ELSE 'auto' END AS content_policy, suffix
FROM (SELECT f.*, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '([.][^./]+)$', 1) AS suffix FROM ({D_FILES}) f) g
WHERE suffix <> '.md' OR name = 'README.md'
"""

D_TRADE = """
SELECT src, dst, kind, CAST(weight AS DOUBLE) AS weight, CAST(0.9 AS DOUBLE) AS confidence FROM (
  SELECT src, dst, 'import' AS kind, round(v / max(v) OVER (), 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) AS n FROM (
    SELECT sn.n_name AS src, cn.n_name AS dst, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY 1, 2) t) u WHERE n <= 2
"""

#: Links between files: to the file a third of the id before (import), and to the one before in the same folder.
D_EDGES = f"""
SELECT a.path AS src, b.path AS dst, 'import' AS kind, CAST(1.0 AS DOUBLE) AS weight, CAST(0.98 AS DOUBLE) AS confidence FROM ({D_CLASSIFIED}) a JOIN ({D_CLASSIFIED}) b ON b.doc_id = CAST(floor(a.doc_id / 3) AS BIGINT) WHERE a.path <> b.path AND a.kind = 'code'
UNION ALL
SELECT a.path AS src, b.path AS dst, 'config_refs_code' AS kind, CAST(0.6 AS DOUBLE) AS weight, CAST(0.8 AS DOUBLE) AS confidence FROM ({D_CLASSIFIED}) a JOIN ({D_CLASSIFIED}) b ON b.doc_id = a.doc_id + 7 WHERE a.kind = 'support' AND b.kind = 'code'
"""


def spark_sql(sql: str) -> str:
    return sql.replace("{bytes}", "octet_length(text)").replace("VARCHAR(20)", "STRING")


def duck_sql(sql: str) -> str:
    return sql.replace("{bytes}", "strlen(text)")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of a folder. Views are named by folder, so that sessions may use several at once."""
    import hashlib
    import re

    mark = "v" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{mark}_{t}")
    sql = re.sub(r"(\b(?:FROM|JOIN)\s+)(" + "|".join(TABLES) + r")\b", rf"\1{mark}_\2", sql)
    return spark.sql(spark_sql(sql))
