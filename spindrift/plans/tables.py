"""The driver's tables seen as symbols, references, edges, spans and commits.

The expressions are the same in Spark and in the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = {
    "id": "p_partkey",
    "name": "p_name",
    "kind": "CASE p_partkey % 4 WHEN 0 THEN 'fn' WHEN 1 THEN 'struct' WHEN 2 THEN 'method' ELSE 'const' END",
    "file": "concat('src/f', p_size, '.rs')",
    "start_line": "p_partkey % 1000",
    "container": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END",
    "qualified_name": "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_brand, '::', p_name) END",
    "service": "concat('s', p_size % 7)",
    "module": "concat('m', p_size % 10)",
    "language": "'rust'",
    "is_test": "p_partkey % 10 = 0",
    "rank": "p_retailprice",
}
EDGES = {"src_symbol": "l_suppkey", "dst_symbol": "l_partkey", "kind": "l_returnflag"}
REFS = {
    "src_symbol": "l_partkey",
    "target": "l_partkey - l_partkey % 200 + (l_partkey * 5 + l_suppkey) % 200",
    "form": "CASE WHEN l_linenumber % 2 = 1 THEN 0 WHEN l_linenumber % 4 = 0 THEN 1 ELSE 2 END",
    "scoped": "l_suppkey % 2 = 0",
    "kind": "l_returnflag",
}
QUALIFIER = "CASE form WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE concat('m', p_size % 10) END"
IMPORTS = {"file": "concat('src/f', (p_partkey * 3) % 50 + 1, '.rs')", "name": "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE concat('m', p_size % 10) END"}
#: Spans of events: those of a user lie in one file, so wide that some hold others.
SPANS = {
    "file": "user_id",
    "id": "event_id",
    "name": "event_type",
    "kind": "CASE event_id % 3 WHEN 0 THEN 'fn' WHEN 1 THEN 'struct' ELSE 'method' END",
    "start_line": "event_id",
    "end_line": "event_id + CASE WHEN event_id % 5 = 0 THEN 1500 WHEN event_id % 5 = 1 THEN 400 ELSE event_id % 60 END",
    "is_test": "event_id % 17 = 0",
}


def listed(columns: dict) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, columns: dict) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{expression} AS {alias}" for alias, expression in columns.items()])
