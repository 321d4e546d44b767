"""The code model, bound to the driver's tables.

A binding gives the rows of one code-model table from tables that are there. It
is SQL that Spark and DuckDB read alike, so that a query and its SQL twin start
from the same rows; what is tested stands in the query. Names in braces are
tables or other bindings; other braces are doubled.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BINDINGS: dict[str, str] = {
    # Packages are languages, modules documents; a module counts a line for each ten characters.
    "modules": """
        SELECT concat('m', doc_id) AS id, doc_id AS seq, lang AS package_id, concat('f', doc_id) AS name, concat('src/', source) AS directory,
               concat('src/', source, '/f', doc_id, CASE WHEN doc_id % 11 = 0 THEN '/index.ts' WHEN doc_id % 3 = 0 THEN '.tsx' ELSE '.ts' END) AS relative_path,
               doc_id % 4 = 0 AS is_barrel, CAST(floor(n_chars / 10) AS BIGINT) AS line_count
        FROM {documents}""",
    # Imports are events: of module event_id % 200, of a path that names module (user_id * 7) % 200 or a package.
    "imports": """
        SELECT concat('i', e.event_id) AS id, e.event_id AS seq, s.id AS module_id, s.package_id, s.relative_path AS from_path,
               CASE e.event_id % 7 WHEN 0 THEN concat('./', t.name) WHEN 1 THEN concat('../', substr(t.directory, 5), '/', t.name)
                    WHEN 2 THEN concat('@/', substr(t.directory, 5), '/', t.name) WHEN 3 THEN concat(t.directory, '/', t.name, '.ts')
                    WHEN 4 THEN concat('@scope/p', e.user_id % 13, '/x') WHEN 5 THEN concat('pkg', e.user_id % 17, '/sub') ELSE '@bare' END AS source,
               e.event_id % 5 = 0 AS is_type_only, concat('s', e.user_id % 50) AS imported,
               CASE WHEN e.event_id % 97 = 0 THEN 'not json' ELSE concat('[{{"imported":"s', e.user_id % 50, '","local":"l', e.event_id % 9, '","kind":"',
                    CASE WHEN e.event_id % 5 = 0 THEN 'type' ELSE 'value' END, '"}}]') END AS specifiers_json
        FROM {events} e JOIN {modules} s ON s.seq = e.event_id % 200 JOIN {modules} t ON t.seq = (e.user_id * 7) % 200""",
    "exports": """
        SELECT concat('e', p_partkey) AS id, concat('m', p_partkey % 200) AS module_id, concat('s', p_partkey % 80) AS name, p_size % 9 = 0 AS is_default FROM {part}""",
    # Classes are customers; an open order is a method, any other a property; a pending one isn't public.
    "classes": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS module_id, c_mktsegment AS package_id FROM {customer}",
    "members": """
        SELECT o_orderkey AS id, o_custkey AS parent_id, CASE WHEN o_orderstatus = 'O' THEN 'method' ELSE 'property' END AS kind,
               CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END AS visibility, o_orderkey % 3 = 0 AS is_async,
               o_orderpriority <> '5-LOW' AS has_explicit_return_type, concat('n', o_orderkey % 700) AS name FROM {orders}""",
    # Declared symbols and calls of them: some names are unique, some shared, some declared nowhere.
    "symbols": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'method' ELSE 'property' END AS kind,
               CASE o_orderkey % 3 WHEN 0 THEN concat('u', o_orderkey) WHEN 1 THEN concat('n', o_orderkey % 700) ELSE concat('t', o_orderkey % 1300) END AS name FROM {orders}""",
    "calls": """
        SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS qualified, o_orderstatus AS relation,
               CASE o_orderkey % 4 WHEN 0 THEN concat('u', o_orderkey) WHEN 1 THEN concat('n', o_orderkey % 900) WHEN 2 THEN concat('t', o_orderkey % 1300) ELSE concat('nowhere', o_orderkey) END AS name FROM {orders}""",
    "parameters": "SELECT l_orderkey AS method_id, l_linenumber AS place, l_quantity AS weight FROM {lineitem}",
    # A symbol reference goes from an order to the one seven numbers on.
    "symbol_references": "SELECT o_orderkey AS id, o_orderkey AS source_id, o_orderkey + 7 AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'method' ELSE 'property' END AS access_kind FROM {orders}",
    # A turn extends the turn before it.
    "extends": "SELECT concat(conv_id, '-', turn) AS class_id, concat(conv_id, '-', turn - 1) AS parent_id FROM {conversations} WHERE turn > 0",
    # Nations import nations: supplier to customer, where that is a quarter more common than on average.
    "trade": """
        SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS n, (SELECT count(*) FROM {lineitem}) AS total
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
        WHERE s.s_nationkey <> c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey""",
    "edges": "SELECT src, dst FROM {trade} WHERE n * 400 >= total",
    "acyclic": "SELECT src, dst FROM {trade} WHERE n * 500 >= total AND src < dst",
    "nodes": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS folder FROM {nation}",
    # View edges have a kind, too: the priority of the orders.
    "view_edges": """
        SELECT s.s_nationkey AS src, c.c_nationkey AS dst,
               CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'import' WHEN '2' THEN 'extends' WHEN '3' THEN 'implements' WHEN '4' THEN 'uses' ELSE 'contains' END AS kind, count(*) AS n
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
        WHERE (l.l_linenumber + l.l_partkey) % 3 > 0 AND (s.s_nationkey * 7 + c.c_nationkey * 3) % 5 < 3 GROUP BY ALL""",
    # Findings are labels; a fact is a customer's orders of a year by priority, a snapshot is a year.
    "issues": """
        SELECT l.doc_id AS id, concat('m', l.doc_id) AS module_id, concat('c', l.doc_id % 40) AS entity_id, CASE WHEN l.doc_id % 3 = 0 THEN concat('c', l.doc_id % 7) END AS parent_id,
               CASE WHEN l.toxic = 1 THEN 'error' WHEN l.quality = 0 THEN 'warn' ELSE 'notice' END AS severity, concat('r', l.doc_id % 12) AS rule_code, d.lang AS package_id
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "facts": """
        SELECT extract(year FROM o_orderdate) AS snapshot, o_custkey AS entity_id, o_orderpriority AS metric_key, CAST(count(*) AS DOUBLE) AS metric_value
        FROM {orders} GROUP BY ALL""",
    "events_json": "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'broken {{' ELSE props END AS props FROM {events}",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def with_clause(sql: str) -> str:
    """sql for DuckDB, with the definitions of the bindings that it names."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in needed or name in TABLES:
            return
        for other in _names(BINDINGS[name]):
            need(other)
        needed.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not needed:
        return sql
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
    made = ", ".join(f"{n} AS ({plain(BINDINGS[n])})" for n in needed)
    body = sql.strip()
    if m := re.match(r"WITH( RECURSIVE)?\s", body, re.I):
        return f"WITH{m[1] or ''} {made}, {body[m.end():]}"
    return f"WITH {made} {body}"


class Bound:
    """The tables and bindings of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.import_graph: DataFrame | None = None  # once it is settled
        self.degrees: DataFrame | None = None  # likewise

    @cached_property
    def _made(self) -> dict[str, DataFrame]:
        return {}

    def keep(self, name: str, frame: DataFrame) -> None:
        """frame stands for a binding from now on."""
        self._made[name] = frame

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = table(self.spark, self.sf_dir, name)
            else:
                sql = BINDINGS[name]
                self._made[name] = self.spark.sql(sql, **{n: self(n) for n in _names(sql)})
        return self._made[name]
