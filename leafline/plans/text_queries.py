"""Queries over text functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.registry import register
from leafline.session import table


@register("text_normalise", "SELECT doc_id, regexp_replace(lower(text), '[^0-9a-zA-Z一-鿿]+', '', 'g') AS match_key, regexp_replace(lower(source || ' Name_1: x'), '[\\s_\\-:：]+', '', 'g') AS field_key, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS excerpt FROM documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.match_key(F.col("text")).alias("match_key"), X.field_key(F.concat("source", F.lit(" Name_1: x"))).alias("field_key"), X.excerpt(F.col("text"), 80).alias("excerpt"))


@register(
    "text_scalars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 100 AS q, 'a b c' AS spaced, 'x_' || l_linenumber || '_y' AS name,
      CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS number, strftime(l_shipdate, '%Y.%m.%d') AS shipped FROM lineitem""",
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    words = F.concat(F.lit("qty "), F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit(" on "), F.date_format("l_shipdate", "yyyy/M/d"))
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 100).alias("q"), X.spaces(F.lit("  a \t b<|txt_split|> c　")).alias("spaced"),
        X.safe_name(F.concat(F.lit("/x "), F.col("l_linenumber").cast("string"), F.lit("::y."))).alias("name"), X.first_decimal(words).alias("number"), X.date_text(words).alias("shipped"),
    )


@register("derived_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN '' ELSE CAST(CAST(round(CAST(l_discount AS DECIMAL(18,4)) * 100 / CAST(l_tax AS DECIMAL(18,4)), 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' END AS ratio FROM lineitem")
def derived_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.ratio_text(F.col("l_discount"), F.col("l_tax")).alias("ratio"))


_KEY = "regexp_replace(lower({x}), '[\\s_\\-./\\\\:：,，。;；()（）\\[\\]【】{{}}<>《》''\"“”‘’|]+', '', 'g')"


@register(
    "term_extract",
    f"""WITH w AS (SELECT item_id, 0 AS o, text AS t FROM benchmark UNION ALL SELECT item_id, unnest(range(1, 1 + len(regexp_extract_all(text, '[A-Za-z0-9_.-]{{2,}}')))), unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]{{2,}}')) FROM benchmark),
      k AS (SELECT item_id, o, {_KEY.format(x="t")} AS k FROM w), f AS (SELECT item_id, k, min(o) AS o FROM k WHERE length(k) >= 2 GROUP BY 1, 2)
      SELECT item_id, count(*) AS terms, string_agg(k, ' ' ORDER BY o) AS joined FROM f GROUP BY 1""",
)
def term_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.terms(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(found).cast("long").alias("terms"), F.array_join(found, " ").alias("joined"))


@register(
    "query_grams",
    """WITH w AS (SELECT n_nationkey, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT n_nationkey, list_filter(regexp_split_to_array(lower(n_name), '[\\s,，.。;；:：/|_\\-]+'), lambda x: x <> '') AS ws FROM nation)),
      g AS (SELECT n_nationkey, i, 0 AS k, 0 AS j, w AS g FROM w UNION ALL SELECT n_nationkey, i, 1, j, substr(w, CAST(j AS BIGINT), 2) FROM (SELECT *, unnest(range(1, length(w))) AS j FROM w WHERE length(w) > 3)
        UNION ALL SELECT n_nationkey, i, 2, j, substr(w, CAST(j AS BIGINT), 3) FROM (SELECT *, unnest(range(1, length(w) - 1)) AS j FROM w WHERE length(w) > 5)),
      d AS (SELECT n_nationkey, g, min(row(i, k, j)) AS o FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY o) AS r FROM d)
      SELECT n_nationkey, string_agg(g, ' ' ORDER BY o) AS grams FROM r WHERE r <= 24 GROUP BY 1""",
)
def query_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(X.query_grams(F.col("n_name")), " ").alias("grams"))


@register(
    "cell_predicates",
    """WITH c AS (SELECT p_partkey, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR) || '%', '', ' 12:30 ', 'total 7 items']) AS cell, unnest(range(7)) AS i FROM part),
      t AS (SELECT p_partkey, i, trim(cell) AS c FROM c),
      n AS (SELECT *, c <> '' AND (regexp_matches(c, '^[-+~]?[0-9]+([.,:：/~\\-][0-9]+)*(%|[A-Za-z]+)?$') OR regexp_matches(c, '^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}$')
        OR (regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Za-z]') AND length(c) <= 32)) AS coded FROM t)
      SELECT p_partkey, i, coded, c <> '' AND length(c) <= 40 AND NOT coded AND length(regexp_replace(c, '[^0-9]', '', 'g')) * 2 <= length(c) AS named FROM n""",
)
def cell_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array("p_name", "p_brand", F.col("p_size").cast("string"), F.concat(F.col("p_size").cast("string"), F.lit("%")), F.lit(""), F.lit(" 12:30 "), F.lit("total 7 items"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(cells).alias("i", "cell"))
    return rows.select("p_partkey", "i", X.numeric_or_code(F.col("cell")).alias("coded"), X.like_key(F.col("cell")).alias("named"))


@register("scope_filters", "SELECT doc_id, doc_id // 10 AS page_no, 'p' || (doc_id // 10) || '-b' || (doc_id % 10) AS block_id FROM documents WHERE doc_id // 10 BETWEEN 3 AND 60 AND (doc_id % 10 = 4 OR doc_id % 10 = 7)")
def scope_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.floor(F.col("doc_id") / 10)
    block = F.concat(F.lit("p"), page.cast("string"), F.lit("-b"), (F.col("doc_id") % 10).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", page.alias("page_no"), block.alias("block_id")).where(F.col("page_no").between(3, 60))
    return rows.where(X.id_matches(F.col("block_id"), F.lit("b4")) | X.id_matches(F.col("block_id"), F.lit("b7")))


@register("visibility_filters", "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_nationkey IN (1, 2, 3) OR c_nationkey % 5 = 0) AND c_acctbal > 0 AND contains(lower(c_name || ' ' || c_mktsegment), 'buil')")
def visibility_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    visible = owner.isNull() | owner.isin(1, 2, 3)
    keyword = F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("buil"))
    return table(spark, sf_dir, "customer").where(visible & (F.col("c_acctbal") > 0) & keyword).select("c_custkey", "c_mktsegment")


@register(
    "html_blocks",
    """SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS list_items, len(regexp_extract_all(html, '<h1[ >]')) AS titles, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs,
      len(regexp_extract_all(html, '<footer[ >]')) AS footers FROM pages""",
)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page by kind, from its markup."""
    tags = F.regexp_extract_all("html", F.lit(r"<(li|h1|p|footer)[ >]"), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", tags.alias("tags"))
    kinds = {"list_items": "li", "titles": "h1", "paragraphs": "p", "footers": "footer"}

    def count(tag: str):
        return F.size(F.filter("tags", lambda x: x == tag)).cast("long")

    return found.select("page_id", *[count(tag).alias(name) for name, tag in kinds.items()])


@register("ordered_unique", "WITH w AS (SELECT conv_id, lower(trim(w)) AS v, row(turn, i) AS o FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)), f AS (SELECT conv_id, v, min(o) AS o FROM w WHERE v <> '' GROUP BY 1, 2) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) AS INT) AS place, v AS value FROM f")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafline.operators.merging import first_unique

    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return first_unique(words.withColumn("w", F.lower("w")), "conv_id", ["turn", "i"], "w")
