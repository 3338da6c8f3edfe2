"""Explicit schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# The given tables, as DDL (fixed values).
TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,parent:string>"

# The engine's own tables.
FILES = (
    "repo_id string, path string, language string, size bigint, line_count bigint, "
    f"blob_sha string, symbols array<{SYMBOL}>, package string, parse_errors boolean"
)
BLOBS = "sha string, content string"
SYMBOLS = (
    "repo_id string, path string, name string, kind string, start_line int, end_line int, "
    "parent string"
)
IMPORTS = (
    "repo_id string, path string, language string, module string, line int, level int, "
    "names array<string>"
)
CHUNKS = (
    "repo_id string, path string, language string, symbol string, kind string, start_line int, "
    "end_line int, content string"
)
EDGES = (
    "repo_id string, src string, dst string, external boolean, dst_is_dir boolean, "
    "specifier string, src_dir string"
)
STEP_EVENTS = (
    "event_id bigint, ts timestamp, job_id string, kind string, step string, status string, "
    "fraction double, level string, message string"
)
AGENT_LOG = (
    "repo_id string, scope string, run_id string, ts timestamp, kind string, tool string, "
    "ok boolean, error_type string, duration_ms bigint, prompt_tokens bigint, "
    "completion_tokens bigint"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
