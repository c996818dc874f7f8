"""Views that read the given tables as package, file and symbol tables, in SQL that Spark and DuckDB both run.

{name} stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    "a_package": """SELECT p_partkey AS package_id, p_name AS name, p_type AS arch, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 4 END AS epoch,
        CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) AS version, CAST(p_partkey % 7 AS STRING) || '.fc' || CAST(18 + p_partkey % 2 AS STRING) AS release,
        CASE WHEN p_size % 5 = 0 THEN 'source' ELSE 'binary' END AS kind, p_partkey AS ordinal, p_brand AS license, p_name || ' (' || p_brand || ')' AS summary,
        p_size AS v1, p_partkey % 10 AS v2, p_partkey % 7 AS r1, 18 + p_partkey % 2 AS r2 FROM {part}""",
    "a_set": "SELECT CAST(r_regionkey AS BIGINT) AS set_id, r_name AS name FROM {region}",
    "a_set_member": """SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS set_id, l_partkey AS package_id FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
        WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
    "a_old_member": """SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS set_id, l_partkey AS package_id FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
        WHERE l_linenumber = 1 AND l_returnflag = 'A'""",
    "a_document": "SELECT doc_id AS contents_id, text, lang, source, CAST((doc_id - doc_id % 2) / 2 AS BIGINT) AS package_id FROM {documents}",
    "a_file": """SELECT doc_id AS file_id, CAST((doc_id - doc_id % 2) / 2 AS BIGINT) AS package_id, doc_id AS contents_id, doc_id % 64 AS attribute_id, CAST(doc_id AS INT) AS inode,
        CASE WHEN doc_id % 3 = 0 THEN '/usr/lib/' WHEN doc_id % 3 = 1 THEN '/etc/' ELSE '/opt/' END || source || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '.conf' WHEN doc_id % 4 = 1 THEN '.so' WHEN doc_id % 4 = 2 THEN '.py' ELSE '' END AS name FROM {documents}""",
    "a_attribute": """SELECT DISTINCT doc_id % 64 AS attribute_id, CAST(32768 + doc_id % 64 * 61 % 4096 AS INT) AS mode, CAST(doc_id % 64 * 7 % 512 AS INT) AS flags, 'user' || CAST(doc_id % 64 % 3 AS STRING) AS user_name, 'group' || CAST(doc_id % 64 % 2 AS STRING) AS group_name, '' AS caps FROM {documents}""",
    # Programs are orders, of the package numbered as their customer; they refer to the parts they returned.
    "a_program": "SELECT o_orderkey AS file_id, o_custkey AS package_id, o_orderkey AS contents_id, o_orderkey % 64 AS attribute_id, '/usr/bin/p' || CAST(o_orderkey AS STRING) AS name FROM {orders}",
    "a_program_attribute": "SELECT DISTINCT o_orderkey % 64 AS attribute_id, CAST(32768 + o_orderkey % 64 * 61 % 4096 AS INT) AS mode FROM {orders}",
    "a_reference": "SELECT DISTINCT l_orderkey AS contents_id, p_name AS name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'A'",
    "a_definition": "SELECT DISTINCT l_orderkey AS contents_id, p_name AS name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
    "a_edges_dag": "SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) WHERE dst IS NOT NULL",
    # Rings within blocks of 20 parts, and an edge to the half of each even number.
    "a_edges_cyclic": "SELECT p_partkey AS src, p_partkey - p_partkey % 20 + (7 * p_partkey + 3) % 20 AS dst FROM {part} UNION SELECT p_partkey, p_partkey - p_partkey % 20 + CAST((p_partkey % 20) / 2 AS BIGINT) FROM {part} WHERE p_partkey % 2 = 0",
    # Libraries are suppliers; they define the parts that came back to them.
    "a_library": """SELECT s_suppkey AS file_id, s_suppkey AS package_id, s_suppkey AS contents_id, CASE WHEN s_suppkey % 4 = 3 THEN '/opt/lib' ELSE '/usr/lib64/lib' END || CAST(s_suppkey AS STRING) || '.so' AS name FROM {supplier}""",
    "a_library_elf": "SELECT s_suppkey AS contents_id, CASE WHEN s_suppkey % 2 = 0 THEN 'x86_64' ELSE 'i386' END AS arch, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'lib' || CAST(s_suppkey % 40 AS STRING) || '.so' END AS soname FROM {supplier}",
    "a_library_definition": "SELECT l_suppkey AS contents_id, p_name AS name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
    "a_object": """SELECT p_partkey AS file_id, p_partkey AS contents_id, p_partkey AS package_id, CASE WHEN p_partkey % 4 = 0 THEN '/lib64/' WHEN p_partkey % 4 = 1 THEN '/usr/lib/' WHEN p_partkey % 4 = 2 THEN '/opt/' || p_brand || '/' ELSE '/usr/lib/' || p_brand || '/' END || p_name AS name,
        CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END AS e_type, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS arch, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS soname FROM {part}""",
    "a_object_needed": """SELECT file, path, arch, needed_name FROM (SELECT file_id AS file, {a_object}.name AS path, p_type AS arch, lag(p_name) OVER (PARTITION BY p_type ORDER BY p_partkey) AS needed_name FROM {a_object} JOIN {part} ON file_id = p_partkey) WHERE needed_name IS NOT NULL""",
    "a_provider": """SELECT coalesce(arch, '') AS arch, coalesce(nullif(soname, ''), p_name) AS soname, file_id, {a_object}.name AS path, p_name AS package FROM {a_object} JOIN {part} ON file_id = p_partkey WHERE e_type = 3""",
    "a_needed": "SELECT DISTINCT l_orderkey AS file, '/opt/' || p_brand || '/app' AS path, p_type AS arch, p_name AS needed_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber = 1",
    "a_segment": """SELECT l_orderkey AS contents_id, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1685382481 ELSE l_linenumber END AS BIGINT) AS type, l_returnflag = 'A' AS readable, l_returnflag <> 'N' AS writable, l_linestatus = 'F' AS executable FROM {lineitem}""",
    "a_dependency": """SELECT DISTINCT l_partkey AS package_id, CASE l_returnflag WHEN 'A' THEN 'require' WHEN 'R' THEN 'provide' ELSE 'conflict' END AS kind, CAST(l_linenumber * 2 AS INT) AS flags, 'cap' || CAST(l_suppkey AS STRING) AS capability, CAST(CAST(l_quantity AS INT) AS STRING) AS version FROM {lineitem}""",
    "a_script": "SELECT conv_id AS package_id, CASE turn % 3 WHEN 0 THEN 'prein' WHEN 1 THEN 'postin' ELSE 'preun' END AS kind, turn, CASE WHEN turn % 4 = 3 THEN '%' || chr(123) || 'macro' || chr(125) ELSE '' END || text AS script FROM {conversations}",
    "a_access": "SELECT CAST(user_id AS STRING) AS url, max(ts) AS last_access FROM {events} GROUP BY user_id",
    "a_class": "SELECT p_partkey AS class_id, p_name || CAST(p_partkey AS STRING) AS name, p_type AS super_class FROM {part}",
    "a_interface": "SELECT p_partkey AS class_id, p_brand AS name FROM {part}",
    "a_release": "SELECT event_type AS name, CAST(user_id AS STRING) AS arch, CAST(NULL AS INT) AS epoch, CAST(CAST(floor(value) AS INT) AS STRING) AS version, CAST(event_id % 10 AS STRING) AS release, event_id AS ordinal, CAST(floor(value) AS INT) AS v1, event_id % 10 AS r1 FROM {events}",
}

_name = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view over the tables below sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = sorted(set(_name.findall(text)))
    alias = {n: f"{n}_in" for n in used}
    body = _name.sub(lambda m: "{" + alias[m[1]] + "}", re.sub(r"\{(\w+)\}\.", r"\1.", text))
    body = re.sub(r"(FROM|JOIN) \{(\w+)_in\}", r"\1 {\2_in} \2", body)
    return spark.sql(body, **{alias[n]: frame(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names, and those they name, defined before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(sql)
    views = [f"{n} AS ({_name.sub(lambda m: m[1], VIEWS[n])})" for n in needed]
    own = re.match(r"\s*WITH (?:RECURSIVE )?", sql)
    if not views:
        return sql
    return "WITH RECURSIVE " + ", ".join(views) + (", " + sql[own.end() :] if own else " " + sql)
