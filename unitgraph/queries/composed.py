"""Sources composed of table rows, a file a row, with the units that they hold as SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import registry
from ..plans import tables as T
from ..plans.lineage import spread

COLUMNS = ["file_path", "ordinal", "unit_type", "qualified_name", "name", "class_name", "signature", "start_line", "end_line", "return_type", "comment", "summary", "body_text", "n_calls"]

#: {k}: the row's key, {n}: a name of the row. A part of the files lacks its last brace.
JAVA = """package shop;
class Part{k} extends Base {
    /** {n}. */
    public int size{k}(int a, String b) {
        return load{k}(a) + check(b);
    }
    Part{k}() { init(); }
"""
SCRIPT = """// {n}
function load{k}(a, b = 2) {
  return fetch{k}(a).then(b);
}
class Supp{k} {
  isOpen(x) { return check(x); }
}
"""
PAGE = """<%-- {n} <% hidden(); %> --%>
<%! private int twice{k}(int n) { return 2 * n; } %>
<% int a = {k};
   int b = 2;
   out.print(a + b); %>
"""
MAPPER = """<mapper namespace="m{k}">
  <select id="find{k}" parameterType="long" resultType="T">SELECT {n} FROM t</select>
  <delete id="drop">DELETE</delete>
</mapper>
"""
POM = "<project><groupId>g{k}</groupId><artifactId>a</artifactId><version>{n}</version></project>"


def _filled(template: str, key: str, name: str):
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col(key).cast("string")), F.lit("{n}"), F.col(name))


def _files(rows: DataFrame, key: str, language: str, text) -> DataFrame:
    return rows.select(F.lit(1).cast("bigint").alias("repo_id"), F.concat(F.lit("f"), F.col(key).cast("string")).alias("file_path"), F.lit(language).alias("language"), F.encode(text, "UTF-8").alias("content"))


def _units(files: DataFrame) -> DataFrame:
    return registry.units(registry.extract(files)).withColumn("n_calls", F.size("calls").cast("int")).select(*COLUMNS)


def java_units(spark, d):
    end = F.when(F.col("p_partkey") % 7 == 0, "").otherwise("}\n")
    return _units(_files(spread(T.table(spark, d, "part"), "p_partkey"), "p_partkey", "java", F.concat(_filled(JAVA, "p_partkey", "p_name"), end)))


def js_units(spark, d):
    return _units(_files(spread(T.table(spark, d, "supplier"), "s_suppkey"), "s_suppkey", "javascript", _filled(SCRIPT, "s_suppkey", "s_name")))


def jsp_units(spark, d):
    return _units(_files(spread(T.table(spark, d, "customer"), "c_custkey"), "c_custkey", "jsp", _filled(PAGE, "c_custkey", "c_name")))


def xml_units(spark, d):
    text = F.when(F.col("s_suppkey") % 2 == 0, _filled(MAPPER, "s_suppkey", "s_name")).otherwise(_filled(POM, "s_suppkey", "s_name"))
    return _units(_files(spread(T.table(spark, d, "supplier"), "s_suppkey"), "s_suppkey", "xml", text))


def encoding_sniff(spark, d):
    """Plain letters, UTF-8, and bytes that only one of the later encodings takes, in turn."""
    odd = F.element_at(F.array(*map(F.lit, ["", "C3A9", "E920", "8120"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = spread(T.table(spark, d, "part"), "p_partkey").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.concat(F.encode("p_name", "UTF-8"), F.unhex(odd)).alias("content"))
    return registry.encodings(files)


def _sql(cte: str, *rows: str) -> str:
    return cte + " " + " UNION ALL ".join(f"SELECT {r}" for r in rows)


def _row(source: str, ordinal: int, unit_type: str, qualified: str, name: str, cls: str, signature: str, start: int, end: int, returns: str, comment: str, summary: str, body: str, calls: int) -> str:
    """One unit of each file; every text is a SQL expression over ``k`` and ``n``."""
    values = ["concat('f', k) AS file_path", f"CAST({ordinal} AS INT) AS ordinal", f"'{unit_type}' AS unit_type", f"{qualified} AS qualified_name", f"{name} AS name", f"{cls} AS class_name", f"{signature} AS signature", f"CAST({start} AS INT) AS start_line", f"CAST({end} AS INT) AS end_line", f"'{returns}' AS return_type", f"{comment} AS comment", f"{summary} AS summary", f"{body} AS body_text", f"CAST({calls} AS INT) AS n_calls"]
    return ", ".join(values) + f" FROM {source}"


JAVA_SQL = _sql(
    "WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS n FROM part)",
    _row("f", 0, "method", "concat('shop.Part', k, '#size', k)", "concat('size', k)", "concat('Part', k)", "concat('public int size', k, '(int a, String b)')", 4, 6, "int", "concat(n, '.')",
         "concat('[Java] class Part', k, ' method size', k, ' | full: Part', k, '.size', k, '(int a, String b) | param types: int String | returns: int | doc: ', n, '. | calls: load', k, ', check')", "concat('{', chr(10), '        return load', k, '(a) + check(b);', chr(10), '    }')", 2),
    _row("f", 1, "constructor", "concat('shop.Part', k, '#Part', k)", "concat('Part', k)", "concat('Part', k)", "concat('void Part', k, '()')", 7, 7, "void", "''", "concat('[Java] class Part', k, ' method Part', k, ' | full: Part', k, '.Part', k, '() | calls: init')", "'{ init(); }'", 1),
)
JS_SQL = _sql(
    "WITH f AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n FROM supplier)",
    _row("f", 0, "function", "concat('load', k)", "concat('load', k)", "''", "concat('function load', k, '(a, b = 2)')", 2, 4, "", "n", "concat('[JS] method load', k, ' | full: load', k, '(a, b = 2) | params: a, b | calls: fetch', k, ', fetch', k, '(a).then')", "concat('{', chr(10), '  return fetch', k, '(a).then(b);', chr(10), '}')", 2),
    _row("f", 1, "function", "concat('Supp', k, '.isOpen')", "'isOpen'", "concat('Supp', k)", "'function isOpen(x)'", 6, 6, "", "''", "concat('[JS] class Supp', k, ' method is Open | full: Supp', k, '.isOpen(x) | params: x | calls: check | boolean check: is Open')", "'{ return check(x); }'", 1),
)
_MERGED = "concat('! private int twice', k, '(int n) { return 2 * n; }', chr(10), 'int a = ', k, ';', chr(10), '   int b = 2;', chr(10), '   out.print(a + b);')"
JSP_SQL = _sql(
    "WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n FROM customer)",
    _row("f", 0, "declaration", "concat('decl_twice', k, '_2')", "concat('twice', k)", "''", "concat('private int twice', k, '(int n)')", 2, 2, "", "''", "concat('[JSP] declaration: private int twice', k, '(int n) at line 2')", "'{ return 2 * n; }'", 0),
    _row("f", 1, "scriptlet", "'scriptlet_0_2'", "'scriptlet@line2'", "''", "'<% ... %> at line 2-5'", 2, 5, "", "''", f"concat('[JSP] scriptlet@line2 | code: ', replace(substr({_MERGED}, 1, 80), chr(10), ' '))", _MERGED, 0),
)
XML_SQL = _sql(
    "WITH f AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n FROM supplier WHERE s_suppkey % 2 = 0), g AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS n FROM supplier WHERE s_suppkey % 2 = 1)",
    _row("f", 0, "mybatis_select", "concat('m', k, '.find', k)", "concat('find', k)", "''", "concat('SELECT m', k, '.find', k)", 2, 2, "", "''", "concat('[XML/MyBatis] SELECT find', k, ' | param: long | result: T | sql: ', substr(concat('SELECT ', n, ' FROM t'), 1, 60))", "concat('SELECT ', n, ' FROM t')", 0),
    _row("f", 1, "mybatis_delete", "concat('m', k, '.drop')", "'drop'", "''", "concat('DELETE m', k, '.drop')", 3, 3, "", "''", "'[XML/MyBatis] DELETE drop | sql: DELETE'", "'DELETE'", 0),
    _row("g", 0, "pom_module", "concat('g', k, '.a')", "'a'", "''", "concat('g', k, ':a:', n)", 1, 1, "", "''", "concat('[XML/Maven] module: a | group: g', k, ' | version: ', n)", "concat('g', k, ':a:', n)", 0),
)
ENCODING_SQL = """SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS file_path, CAST(octet_length(encode(p_name)) + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_bytes,
  ['utf-8', 'utf-8', 'cp1252', 'latin-1'][CAST(p_partkey % 4 + 1 AS INT)] AS encoding FROM part"""

QUERIES = {
    "q_java_units": (java_units, JAVA_SQL),
    "q_js_units": (js_units, JS_SQL),
    "q_jsp_units": (jsp_units, JSP_SQL),
    "q_xml_units": (xml_units, XML_SQL),
    "q_encoding_sniff": (encoding_sniff, ENCODING_SQL),
}
