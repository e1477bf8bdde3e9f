"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilcheck.sources.tables import read_texts

# A few lines of each of ten kinds of files, and the whole text of the document after them.
CODE_FILES = """
WITH k AS (SELECT *, CAST(doc_id AS STRING) AS s, md5(CAST(doc_id AS STRING)) AS h,
                  md5(source) AS g, md5(lang) AS l, chr(10) AS nl FROM documents)
SELECT doc_id AS file_id,
  source || '/p' || s || '/' ||
  CASE doc_id % 10 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'web/index.js' WHEN 2 THEN '.env'
    WHEN 3 THEN 'deploy/values.yaml' WHEN 4 THEN 'cmd/main.go' WHEN 5 THEN 'README.txt'
    WHEN 6 THEN 'static/logo.png' WHEN 7 THEN 'node_modules/x/index.js'
    WHEN 8 THEN 'keys/id.pem' ELSE 'src/chain.py' END AS path,
  CASE doc_id % 10
   WHEN 0 THEN 'import requests' || nl || 'API_KEY = "AKIA' || upper(substr(h,1,16)) || '"' || nl
     || 'requests.get(url, headers=API_KEY)' || nl || 'print("done")' || nl
   WHEN 1 THEN 'const token = "' || h || '";' || nl || '// token = "' || g || '"' || nl || 'console.log(token);' || nl
   WHEN 2 THEN 'DB_PASSWORD="' || substr(h,1,20) || '"' || nl || 'URL=redis://svc:' || substr(g,1,8) || '@cache:6379/0' || nl
     || 'vk_token=' || h || substr(g,1,8) || nl || 'vk_api=' || substr(h,1,24) || nl || 'sber_api_key=' || substr(g,1,24) || nl
   WHEN 3 THEN 'auth: Bearer eyJ' || h || '.' || g || '.' || l || nl || 'password: "example-' || substr(l,1,10) || '"' || nl
     || 'api-key: ' || h || nl || 'client_id: ' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-'
     || substr(h,17,4) || '-' || substr(h,21,12) || nl || 'a: crp_' || h || nl || 'b: crsa_' || g || nl
     || 'c: tinkoff_' || l || nl || 'd: merchant_' || h || nl
   WHEN 4 THEN 'package main' || nl || nl || 'var id = "sber_' || h || '"' || nl || 'k = "AQ' || upper(h) || g || '"' || nl
     || 'v := "vk' || h || g || '"' || nl || 'bot := "' || CAST(1000000000 + doc_id AS STRING) || ':AA' || upper(h) || '"' || nl
     || 'o := "t1.' || h || g || l || upper(h) || '"' || nl || 'i := "eyJ' || h || '.eyJ' || g || '.t1.' || l || h || '"' || nl || 'fmt.Print(k)' || nl
   WHEN 5 THEN ''
   WHEN 6 THEN 'token = "' || h || '"' || nl
   WHEN 7 THEN 'token = "' || h || '"' || nl
   WHEN 8 THEN '-----BEGIN ' || 'RSA PRIVATE KEY-----' || nl || h || nl
   ELSE 'import logging' || nl || 'SECRET = "' || upper(g) || h || '"' || nl || 'derived = SECRET' || nl || 'h = derived' || nl
     || 'x = 1' || nl || 'logging.info(h)' || nl || 'y = requests.post(u, data=h)' || nl
  END || coalesce(text, '') AS content
FROM k
"""

# Three commits of all files: some files change, some become empty.
BLOBS = """
SELECT commit_ord, md5('commit' || CAST(commit_ord AS STRING)) AS commit_id, file_id AS path_ord, path,
  md5(body) AS blob_hash, body AS content
FROM (SELECT commit_ord, file_id, path,
        CASE WHEN file_id % 3 = commit_ord AND file_id % 7 = 0 THEN ''
             WHEN file_id % 3 = commit_ord THEN content || chr(10) || 'rev = ' || CAST(commit_ord AS STRING)
             ELSE content END AS body
      FROM (SELECT 0 AS commit_ord, file_id, path, content FROM code_files
            UNION ALL SELECT 1 AS commit_ord, file_id, path, content FROM code_files
            UNION ALL SELECT 2 AS commit_ord, file_id, path, content FROM code_files) c) t
"""

# Code files with a last line that is worth a review in three cases out of four.
SCRIPTS = """
SELECT file_id, path, content || CASE file_id % 4 WHEN 0 THEN chr(10) || 'os.system (x)'
  WHEN 1 THEN chr(10) || 'q = "select a from b" + name' WHEN 2 THEN chr(10) || 'YAML.load(y)' ELSE '' END AS content
FROM code_files
"""

TARGETS = """
SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN 'git@host.example:grp/p' || CAST(page_id AS STRING)
    WHEN 1 THEN 'https://host.example/grp/p' || CAST(page_id AS STRING) || '.git'
    WHEN 2 THEN 'https://github.com/grp/p' || CAST(page_id AS STRING)
    WHEN 3 THEN 'https://host.example/dl/p' || CAST(page_id AS STRING) || '.ZIP?x=1'
    WHEN 4 THEN 'ftp://host.example/p' || CAST(page_id AS STRING) || '.git'
    ELSE url END AS url
FROM pages
"""

# Every seventh review names a file that is not there.
REVIEWS = """
SELECT file_id, CASE WHEN file_id % 7 = 3 THEN 'gone/' ELSE '' END || path AS path,
  CASE file_id % 4 WHEN 0 THEN '[HIGH] - L3: requests.get(url)' || chr(10) || 'noise' || chr(10) || 'low - print("done")'
    WHEN 1 THEN '[SAFE]'
    WHEN 2 THEN 'КРИТИЧЕСКАЯ - L99: os.system(x)' || chr(10) || '[WHATEVER] - L1: x'
    ELSE ' [средняя] -  logging.info(h) ' || chr(10) || '[НИЗКАЯ] - not in file' END AS response
FROM code_files
"""

MANIFEST = """
SELECT DISTINCT source AS project, source < 'src3' AS vulnerable,
  CASE WHEN source < 'src5' THEN 'python' ELSE 'go' END AS language
FROM documents
"""

VIEWS = {
    "code_files": CODE_FILES, "scripts": SCRIPTS, "blobs": BLOBS, "targets": TARGETS, "reviews": REVIEWS,
    "manifest": MANIFEST,
}
# The base tables and the columns that the derived inputs need.
BASE_TABLES = {"documents": ["doc_id", "text", "lang", "source"], "pages": ["page_id", "url"]}


def test_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A given table.  Those for tests come as one row group, which one task would scan alone, so their rows are dealt out.

    Larger ones go to more tasks, so that a task's share does not grow with the table.
    """
    table = read_texts(spark, path, *columns)
    return table.repartition(max(spark.sparkContext.defaultParallelism, 4 * table.rdd.getNumPartitions()))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    derived = "code_files" in sql
    for table, columns in BASE_TABLES.items():
        if f"FROM {table}" in (sql + CODE_FILES if derived else sql):
            test_table(spark, f"{sf_dir}/{table}.parquet", *columns).createOrReplaceTempView(table)
    if derived:
        spark.sql(CODE_FILES).createOrReplaceTempView("code_files")
    return spark.sql(sql)
