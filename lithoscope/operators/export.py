"""Topology as GraphML, Mermaid and DOT: one row per line, in order (section, nth), never gathered into one string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def xml(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def dot(c):
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), c).otherwise(quoted)


def mermaid(c):
    return F.regexp_replace(c, r"[#\[\]()]", "_")


def placed(section: int, rows: DataFrame, line, *order) -> DataFrame:
    """Lines numbered by their order; the numbering of a file's lines is global by nature."""
    nth = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.select(F.lit(section).alias("section"), nth.alias("nth"), *[F.col(c) for c in rows.columns]).select("section", "nth", line.alias("line"))


def framed(nodes: DataFrame, edges: DataFrame, head: list[str], node, edge, tail: list[str]) -> DataFrame:
    spark = nodes.sparkSession
    fixed = lambda section, lines: spark.createDataFrame([(section, i, s) for i, s in enumerate(lines)], "section int, nth int, line string")
    body = placed(1, nodes.select("id"), node, "id").unionAll(placed(2, edges.select("from", "to"), edge, "from", "to"))
    return fixed(0, head).unionAll(body).unionAll(fixed(3, tail))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <graph id="G" edgedefault="directed">']
    node = F.concat(F.lit('    <node id="'), xml(F.col("id")), F.lit('"><data key="label">'), xml(F.col("id")), F.lit("</data></node>"))
    edge = F.concat(F.lit('    <edge id="e'), F.col("nth").cast("string"), F.lit('" source="'), xml(F.col("from")), F.lit('" target="'), xml(F.col("to")), F.lit('"/>'))
    return framed(nodes, edges, head, node, edge, ["  </graph>", "</graphml>"])


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    node = F.concat(F.lit("  "), mermaid(F.col("id")), F.lit('["'), F.replace(F.col("id"), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    edge = F.concat(F.lit("  "), mermaid(F.col("from")), F.lit(" --> "), mermaid(F.col("to")))
    return framed(nodes, edges, ["graph LR"], node, edge, [])


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    node = F.concat(F.lit("  "), dot(F.col("id")), F.lit(" [label="), dot(F.col("id")), F.lit("];"))
    edge = F.concat(F.lit("  "), dot(F.col("from")), F.lit(" -> "), dot(F.col("to")), F.lit(";"))
    return framed(nodes, edges, ["digraph topology {"], node, edge, ["}"])


FORMATS = {"graphml": graphml, "mermaid": mermaid_lines, "dot": dot_lines}


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as one text file in a folder: an export is a single file by contract."""
    lines.orderBy("section", "nth").select("line").coalesce(1).write.mode("overwrite").text(path)
