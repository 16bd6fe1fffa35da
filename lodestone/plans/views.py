"""Stand-ins for the reference's relations over the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import table

#: DuckDB text of each view, by name; a view may use those above it.
DUCKDB = {
    "v_entities": """
        SELECT concat('R', CAST(r_regionkey AS VARCHAR)) AS entity_id, 'region' AS entity_type, r_name AS canonical_name FROM region
        UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR)), 'nation', n_name FROM nation
        UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), 'customer', c_name FROM customer
        UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR)), 'supplier', s_name FROM supplier""",
    "v_edges": """
        SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS src, 'part_of' AS relation, concat('R', CAST(n_regionkey AS VARCHAR)) AS dst FROM nation
        UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), 'located_in', concat('N', CAST(c_nationkey AS VARCHAR)) FROM customer
        UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR)), 'located_in', concat('N', CAST(s_nationkey AS VARCHAR)) FROM supplier
        UNION ALL SELECT DISTINCT concat('S', CAST(l_suppkey AS VARCHAR)), 'supplies', concat('P', CAST(l_partkey AS VARCHAR)) FROM lineitem""",
    "v_tree": "SELECT src AS child, dst AS parent FROM v_edges WHERE relation IN ('part_of', 'located_in')",
    "v_runs": """
        SELECT event_id AS run_id, event_type AS suite_id, concat('v', CAST(user_id % 3 AS VARCHAR)) AS code_version, ts AS started_at,
               value AS score, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS passed, user_id AS case_id FROM events""",
    "v_limits": """
        SELECT 100 AS priority, concat('R', CAST(r.r_regionkey AS VARCHAR)) AS profile_id, CAST(max(o.o_totalprice) AS DECIMAL(18,2)) AS value_numeric
        FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_regionkey
        UNION ALL SELECT 200, concat('N', CAST(n.n_nationkey AS VARCHAR)), CAST(max(o.o_totalprice) AS DECIMAL(18,2))
        FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_nationkey
        UNION ALL SELECT 500, concat('C', CAST(o.o_custkey AS VARCHAR)), CAST(min(o.o_totalprice) AS DECIMAL(18,2)) FROM orders o GROUP BY o.o_custkey""",
    "v_evidence": """
        SELECT doc_id, CAST(pos AS BIGINT) AS line_no, trim(line) AS normalized_text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE trim(line) <> ''""",
    "v_terms": """
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9./-]+')) AS term FROM documents) GROUP BY doc_id, term""",
    "v_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
}


def with_views(sql: str) -> str:
    """`sql` behind the definitions of the views that it names, directly or not."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in DUCKDB:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(DUCKDB[name])
                need.append(name)

    visit(sql)
    sql = sql.strip()
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({DUCKDB[n]})" for n in need)
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I):
        return f"WITH {m[1] or ''}{ctes},\n{sql[m.end():]}"
    return f"WITH {ctes}\n{sql}"


class Tables:
    """The tables of a folder and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    @property
    def v_entities(self) -> DataFrame:
        def part(df: DataFrame, mark: str, kind: str, key: str, name: str) -> DataFrame:
            return df.select(F.concat(F.lit(mark), F.col(key)).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name"))

        return (
            part(self.region, "R", "region", "r_regionkey", "r_name")
            .unionByName(part(self.nation, "N", "nation", "n_nationkey", "n_name"))
            .unionByName(part(self.customer, "C", "customer", "c_custkey", "c_name"))
            .unionByName(part(self.supplier, "S", "supplier", "s_suppkey", "s_name"))
        )

    @property
    def v_edges(self) -> DataFrame:
        def part(df: DataFrame, src: tuple[str, str], relation: str, dst: tuple[str, str]) -> DataFrame:
            return df.select(F.concat(F.lit(src[0]), F.col(src[1])).alias("src"), F.lit(relation).alias("relation"), F.concat(F.lit(dst[0]), F.col(dst[1])).alias("dst"))

        supplies = self.lineitem.select("l_suppkey", "l_partkey").distinct()
        return (
            part(self.nation, ("N", "n_nationkey"), "part_of", ("R", "n_regionkey"))
            .unionByName(part(self.customer, ("C", "c_custkey"), "located_in", ("N", "c_nationkey")))
            .unionByName(part(self.supplier, ("S", "s_suppkey"), "located_in", ("N", "s_nationkey")))
            .unionByName(part(supplies, ("S", "l_suppkey"), "supplies", ("P", "l_partkey")))
        )

    @property
    def v_tree(self) -> DataFrame:
        """Child to parent: customers and suppliers under nations under regions."""
        return self.v_edges.filter(F.col("relation").isin("part_of", "located_in")).select(F.col("src").alias("child"), F.col("dst").alias("parent"))

    @property
    def v_runs(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("run_id"),
            F.col("event_type").alias("suite_id"),
            F.concat(F.lit("v"), F.col("user_id") % 3).alias("code_version"),
            F.col("ts").alias("started_at"),
            F.col("value").alias("score"),
            F.when(F.col("value") >= 100, 1).otherwise(0).alias("passed"),
            F.col("user_id").alias("case_id"),
        )

    @property
    def v_limits(self) -> DataFrame:
        placed = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        price = lambda f: f("o_totalprice").cast("decimal(18,2)").alias("value_numeric")
        row = lambda p, mark, key: (F.lit(p).alias("priority"), F.concat(F.lit(mark), F.col(key)).alias("profile_id"), "value_numeric")
        return (
            placed.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(price(F.max)).select(*row(100, "R", "r_regionkey"))
            .unionByName(placed.groupBy("n_nationkey").agg(price(F.max)).select(*row(200, "N", "n_nationkey")))
            .unionByName(self.orders.groupBy("o_custkey").agg(price(F.min)).select(*row(500, "C", "o_custkey")))
        )

    @property
    def v_evidence(self) -> DataFrame:
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.trim("line").alias("normalized_text")).filter("normalized_text <> ''")

    @property
    def v_terms(self) -> DataFrame:
        return T.term_counts(self.documents, "doc_id", "text")

    @property
    def v_props(self) -> DataFrame:
        return self.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
