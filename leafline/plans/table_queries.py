"""Queries over HTML tables made from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import tables as T
from leafline.plans.adapters import HEADERS, LINES, line_tables, span_tables
from leafline.registry import register
from leafline.session import table


def kv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table an order of a header's pairs: rows of two and of four cells."""
    # a small file is one split, and its markup would be read by one task
    o = table(spark, sf_dir, "orders").repartition("o_orderkey")

    def cell(x: object) -> object:
        return F.concat(F.lit("<td>"), x, F.lit("</td>"))

    one = F.concat(F.lit("<tr>"), cell(F.lit("Status:")), cell(F.col("o_orderstatus")), cell(F.lit("Priority")), cell(F.col("o_orderpriority")), F.lit("</tr>"))
    two = F.concat(F.lit("<tr>"), cell(F.lit("Customer")), cell(F.col("o_custkey").cast("string")), F.lit("</tr>"))
    three = F.concat(F.lit("<tr>"), cell(F.lit("Ordered &amp; dated")), cell(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("</tr>"))
    return o.select(F.col("o_orderkey").alias("table_id"), F.concat(F.lit("<table>"), one, two, three, F.lit("</table>")).alias("html"))


def object_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order, a header, and its lines as numbered rows of two cells."""
    from leafline.plans.adapters import lines

    row = F.concat(F.lit("<tr><td>"), (F.col("row_index") + 1).cast("string"), F.lit("</td><td>"), F.col("part"), F.lit("</td></tr>"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("row_index", row.alias("h")))), lambda x: x["h"])
    made = lines(spark, sf_dir).groupBy("table_id").agg(F.array_join(listed, "").alias("rows"))
    head = F.concat(F.lit("<table><tr><td>Order</td><td>"), F.col("table_id").cast("string"), F.lit("</td></tr><tr><th>Item</th><th>Part</th></tr>"))
    return made.select("table_id", F.concat(head, F.col("rows"), F.lit("</table>")).alias("html"))


@register(
    "table_roundtrip_records",
    """SELECT l_orderkey AS table_id, count(*) AS records, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
      count(*) FILTER (l_returnflag = 'R') AS returned, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_shipped FROM lineitem GROUP BY 1""",
)
def table_roundtrip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written as HTML tables, read back as records and summed."""
    view = T.record_view(T.record_regions(T.grid(line_tables(spark, sf_dir), ids=False)))
    rows = T.records(view, list(HEADERS))
    return rows.groupBy("table_id").agg(
        F.count("*").alias("records"),
        F.sum(F.col("Quantity").cast("decimal(18,2)")).alias("quantity"),
        F.sum(F.col("Price").cast("decimal(18,2)")).alias("price"),
        F.sum((F.col("Flag") == "R").cast("long")).alias("returned"),
        F.max("Shipped").alias("last_shipped"),
    )


@register(
    "table_records_long",
    f"""WITH {LINES} SELECT table_id, CAST(row_index AS INT) AS record_index, unnest(range(6)) AS column_index, unnest(['Line', 'Part', 'Quantity', 'Price', 'Flag', 'Shipped']) AS header,
      unnest([line, part, quantity, price, flag, shipped]) AS value FROM lines""",
)
def table_records_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.records_long(T.record_view(T.record_regions(T.grid(line_tables(spark, sf_dir), ids=False))))


@register(
    "table_grid_shape",
    f"""WITH {LINES}, a AS (SELECT table_id, line || part || quantity || price || flag || shipped AS t FROM lines)
      SELECT table_id, count(*) + 1 AS row_count, 6 AS min_width, 6 AS max_width, 0 AS empty_share, count(*) - count(DISTINCT t) AS repeated_rows, count(*) + 1 >= 24 AS is_large FROM a GROUP BY 1""",
)
def table_grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shape(T.grid(line_tables(spark, sf_dir), ids=False))


@register(
    "table_uncertainties",
    f"""WITH {LINES}, a AS (SELECT table_id, line || part || quantity || price || flag || shipped AS t FROM lines)
      SELECT table_id, concat_ws(',', CASE WHEN count(*) + 1 >= 24 THEN 'large_table' END, CASE WHEN count(*) > count(DISTINCT t) THEN 'repeated_rows' END) AS marks FROM a GROUP BY 1""",
)
def table_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.grid(line_tables(spark, sf_dir), ids=False)
    return T.uncertainties(T.shape(rows), T.record_regions(rows))


@register(
    "table_span_expand",
    f"""WITH {LINES} SELECT table_id, 1 AS row_index, concat_ws('|', 'Order ' || table_id, 'Order ' || table_id, 'Order ' || table_id, 'Order ' || table_id) AS cells FROM (SELECT DISTINCT table_id FROM lines)
      UNION ALL SELECT table_id, 2, 'Flag|Line|Part|Price' FROM (SELECT DISTINCT table_id FROM lines)
      UNION ALL SELECT table_id, row_index + 3, concat_ws('|', flag, line, part, price) FROM lines""",
)
def table_span_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grid(span_tables(spark, sf_dir), ids=False).select("table_id", "row_index", F.array_join("cells", "|").alias("cells"))


@register(
    "table_span_display",
    f"""WITH {LINES}, f AS (SELECT *, lag(flag) OVER (PARTITION BY table_id ORDER BY row_index) IS NOT DISTINCT FROM flag AS again FROM lines)
      SELECT table_id, 1 AS row_index, 'Order ' || table_id || '|||' AS shown FROM (SELECT DISTINCT table_id FROM lines)
      UNION ALL SELECT table_id, 2, 'Flag|Line|Part|Price' FROM (SELECT DISTINCT table_id FROM lines)
      UNION ALL SELECT table_id, row_index + 3, CASE WHEN again THEN '' ELSE flag END || '|' || line || '|' || part || '|' || price FROM f""",
)
def table_span_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.display(T.grid(span_tables(spark, sf_dir)))


@register(
    "table_span_records",
    f"""WITH {LINES} SELECT table_id, row_index AS record_index, flag AS "Flag", line AS "Line", part AS "Part", price AS "Price" FROM lines""",
)
def table_span_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records below a title row and beside cells that span rows."""
    view = T.record_view(T.record_regions(T.grid(span_tables(spark, sf_dir), ids=False)))
    return T.records(view, ["Flag", "Line", "Part", "Price"])


@register(
    "table_merged_cells",
    f"""WITH {LINES}, f AS (SELECT *, CASE WHEN lag(flag) OVER w IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS s FROM lines WINDOW w AS (PARTITION BY table_id ORDER BY row_index)),
      g AS (SELECT *, sum(s) OVER (PARTITION BY table_id ORDER BY row_index) AS g FROM f),
      m AS (SELECT table_id, min(row_index) AS r, any_value(flag) || ' (' || count(*) || 'x1)' AS n FROM g GROUP BY table_id, g HAVING count(*) > 1
        UNION ALL SELECT DISTINCT table_id, -1, 'Order ' || table_id || ' (1x4)' FROM lines)
      SELECT table_id, count(*) AS merged, string_agg(n, '; ' ORDER BY r) AS notes FROM m GROUP BY 1""",
)
def table_merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merged_cells(span_tables(spark, sf_dir))


@register(
    "table_kv_pairs",
    """SELECT o_orderkey AS table_id, unnest([1, 1, 2, 3]) AS row_index, unnest(['Status', 'Priority', 'Customer', 'Ordered & dated']) AS key,
      unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d')]) AS value FROM orders""",
)
def table_kv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pairs(T.grid(kv_tables(spark, sf_dir), ids=False))


@register(
    "table_kv_record_object",
    f"""WITH {LINES}, b AS (SELECT table_id FROM lines GROUP BY 1 HAVING count(*) >= 2)
      SELECT table_id, 1 AS row_index, 'kv' AS part, 'Order' AS key, CAST(table_id AS VARCHAR) AS value FROM b
      UNION ALL SELECT table_id, row_index + 3, 'detail', CAST(row_index + 1 AS VARCHAR), part FROM lines JOIN b USING (table_id)""",
)
def table_kv_record_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.composite_objects(T.grid(object_tables(spark, sf_dir), ids=False))


@register(
    "table_role_counts",
    """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'line' AS source, CASE WHEN n >= 2 THEN 'record' ELSE 'mixed' END AS role, count(*) AS tables FROM n GROUP BY ALL
      UNION ALL SELECT 'kv', 'kv', count(*) FROM orders UNION ALL SELECT 'span', CASE WHEN n <= 3 THEN 'kv' ELSE 'sectioned' END, count(*) FROM n GROUP BY ALL""",
)
def table_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of line tables, pair tables and tables with a title over merged cells."""
    out = None
    for name, made in (("line", line_tables(spark, sf_dir)), ("kv", kv_tables(spark, sf_dir)), ("span", span_tables(spark, sf_dir))):
        found = T.table_roles(T.grids(made)).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("source", "role").agg(F.count("*").alias("tables"))


@register("table_grid_facts", f"WITH {LINES}, c AS (SELECT table_id, row_index + 2 AS row_index, [line, part, quantity, price, flag, shipped] AS c FROM lines UNION ALL SELECT DISTINCT table_id, 1, ['Line', 'Part', 'Quantity', 'Price', 'Flag', 'Shipped'] FROM lines), d AS (SELECT table_id, row_index, list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]) AS d FROM c) SELECT table_id, row_index, len(d) AS n_cells, array_to_string(d, ' | ') AS row_text FROM d")
def table_grid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grid_facts(T.grid(line_tables(spark, sf_dir), ids=False))


@register("table_blobs", "SELECT l_orderkey // 10 AS id, CAST(row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey) - 1 AS INT) AS table_no, count(*) + 1 AS row_count FROM lineitem GROUP BY l_orderkey")
def table_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in texts that hold several between other words."""
    made = line_tables(spark, sf_dir)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("table_id", "html"))), lambda x: x["html"])
    blobs = made.groupBy(F.floor(F.col("table_id") / 10).alias("id")).agg(F.concat(F.lit("before "), F.array_join(listed, " and "), F.lit(" after")).alias("text"))
    found = T.tables_in(blobs, "id", "text")
    return found.select("id", "table_no", F.size(F.regexp_extract_all("html", F.lit("(<tr>)"), F.lit(1))).alias("row_count"))
