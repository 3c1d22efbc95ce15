"""Pieces of SQL that several queries share: the derived graph, and text normalisation in DuckDB's dialect."""

from __future__ import annotations

from functools import reduce

from quillgraph.functions.text import STOPWORDS, latin_decompositions

NODES = """
SELECT 'dom:' || r_regionkey AS id, 'Domain' AS type, r_name AS name, 'domain' AS layer, CAST(NULL AS INTEGER) AS year FROM region
UNION ALL SELECT 'sub:' || n_nationkey, 'Domain', n_name, 'domain', NULL FROM nation
UNION ALL SELECT 'm:' || p_partkey, 'Method', p_name, 'method', NULL FROM part
UNION ALL SELECT 'p:' || s_suppkey, 'Problem', s_name, 'problem', NULL FROM supplier
UNION ALL SELECT 'b:' || c_custkey, 'Benchmark', c_name, 'evaluation', NULL FROM customer
UNION ALL SELECT 'o:' || o_orderkey, 'Paper', 'paper ' || o_orderkey, 'paper', CAST(year(o_orderdate) AS INTEGER) FROM orders
"""
EDGES = """
SELECT DISTINCT 'o:' || l_orderkey AS src, 'm:' || l_partkey AS dst, 'USES' AS type, 'cross-layer' AS layer_scope FROM lineitem
UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_suppkey, 'ADDRESSES', 'cross-layer' FROM lineitem
UNION ALL SELECT 'b:' || o_custkey, 'o:' || o_orderkey, 'CONTAINS', 'cross-layer' FROM orders
UNION ALL SELECT 'p:' || s_suppkey, 'sub:' || s_nationkey, 'BELONGS_TO_DOMAIN', 'cross-layer' FROM supplier
UNION ALL SELECT 'b:' || c_custkey, 'sub:' || c_nationkey, 'BELONGS_TO_DOMAIN', 'cross-layer' FROM customer
UNION ALL SELECT 'sub:' || n_nationkey, 'dom:' || n_regionkey, 'BELONGS_TO_DOMAIN', 'intra-layer' FROM nation
"""
GRAPH = f"WITH RECURSIVE nodes AS ({NODES}), edges AS ({EDGES})"


def normalized(expr: str) -> str:
    """Normalised text of an SQL expression."""
    low = reduce(lambda x, g: f"regexp_replace({x}, '[{g[1]}]', '{g[0]}', 'g')", latin_decompositions().items(), f"lower({expr})")
    return rf"trim(regexp_replace(regexp_replace({low}, '[^\p{{L}}\p{{N}} \t\n\r\f\x0B-]', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def tokens(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: t <> '')"


def content_tokens(norm: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(string_split({norm}, ' '), lambda t: length(t) > 2 AND NOT list_contains([{words}], t))"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct tokens."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"
