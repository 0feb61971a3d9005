"""Aggregations A01-A28 and ranking W01-W11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import table
from traceframe.plans.sizing import bounded_broadcast
from traceframe.operators.joins import division

ONE = "count(*)"


def n() -> object:
    return F.count(F.lit(1))


def ordered(column: str, *order: str) -> object:
    """Values of a column in the order of others, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda x: x["_v"])


@query("a01_most_common", "SELECT event_type, count(*) AS n, min(event_id) AS first, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS place FROM events GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """Ties keep the order of first appearance."""
    by = table(spark, d, "events").groupBy("event_type").agg(n().alias("n"), F.min("event_id").alias("first"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint"))


@query("a02_counts_per_mark", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def a02(spark: SparkSession, d: str) -> DataFrame:
    pivot = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(n())
    return pivot.na.fill(0)


@query("a03_rank_classes", "SELECT l_returnflag, count(*) FILTER (l_quantity < 10) AS rank0, count(*) FILTER (l_quantity >= 10 AND l_quantity < 40) AS rank1, count(*) FILTER (l_quantity >= 40) AS rank2 FROM lineitem GROUP BY 1")
def a03(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(q < 10).alias("rank0"), F.count_if((q >= 10) & (q < 40)).alias("rank1"), F.count_if(q >= 40).alias("rank2"))


@query("a04_fold_lines", "SELECT l_partkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first, list_sort(list(l_orderkey * 10 + l_linenumber))[2:] AS others FROM lineitem GROUP BY 1, 2")
def a04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    held = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sort_array(F.collect_list(k)).alias("k"))
    return held.select("l_partkey", "l_returnflag", F.get("k", 0).alias("first"), F.slice("k", F.lit(2), F.greatest(F.size("k") - 1, F.lit(0))).alias("others"))


@query("a05_group_alike", "SELECT p_brand, p_type, p_size, count(*) AS n, list_sort(list(p_partkey)) AS keys FROM part GROUP BY 1, 2, 3")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(n().alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("keys"))


@query("a06_strongest_kind", "SELECT user_id, json_extract_string(props, '$.k') AS k, min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS kind FROM events GROUP BY 1, 2")
def a06(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, d, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.min(rank).alias("kind"))


@query("a07_relational_division", "SELECT event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase')")
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Event types that every buying user has."""
    e = table(spark, d, "events")
    return division(e, "event_type", "user_id", e.filter("event_type = 'purchase'"))


@query(
    "a08_top_values_of_keys",
    """WITH v AS (SELECT event_type, user_id, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2, 3), t AS (SELECT event_type, user_id, sum(n) AS total FROM v GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) AS key_place FROM t)
    SELECT event_type, user_id, total::BIGINT AS total, (SELECT list(k ORDER BY n DESC, k) FROM (SELECT k, n FROM v WHERE v.event_type = top.event_type AND v.user_id = top.user_id ORDER BY n DESC, k LIMIT 3)) AS best FROM top WHERE key_place <= 8""",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    v = e.groupBy("event_type", "user_id", "k").agg(n().alias("n"))
    place = Window.partitionBy("event_type", "user_id").orderBy(F.desc("n"), "k")
    best = v.withColumn("i", F.row_number().over(place)).groupBy("event_type", "user_id").agg(F.sum("n").alias("total"), F.transform(F.sort_array(F.collect_list(F.when(F.col("i") <= 3, F.struct("i", "k")))), lambda x: x["k"]).alias("best"))
    return best.withColumn("key_place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("total"), "user_id"))).filter("key_place <= 8").drop("key_place")


@query(
    "a09_value_distribution",
    """WITH g AS (SELECT event_type, user_id % 3 AS region, count(*) AS n, count(*) FILTER (value < 10) AS low, list_sort(list(event_id))[1:3] AS examples FROM events GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY n DESC, event_type, region) AS place FROM g ORDER BY place LIMIT 8""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("region", F.col("user_id") % 3)
    first = e.withColumn("i", F.row_number().over(Window.partitionBy("event_type", "region").orderBy("event_id")))
    g = first.groupBy("event_type", "region").agg(n().alias("n"), F.count_if(F.col("value") < 10).alias("low"), F.sort_array(F.collect_list(F.when(F.col("i") <= 3, F.col("event_id")))).alias("examples"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type", "region")).cast("bigint")).filter("place <= 8")


@query("a10_files_of_configs", "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'en'").groupBy("source").agg(n().alias("n"))


@query("a14_rollup_agreement", "SELECT coalesce(lang, 'all') AS lang, count(*) AS n, count(*) FILTER (n_chars > 1000 AND quality = 1) AS both, round(count(*) FILTER (n_chars > 1000 AND quality = 1) / nullif(count(*) FILTER (n_chars > 1000), 0), 6) AS precision, round(count(*) FILTER (n_chars > 1000 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def a14(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    said, true = F.count_if(F.col("n_chars") > 1000), F.count_if(F.col("quality") == 1)
    hit = F.count_if((F.col("n_chars") > 1000) & (F.col("quality") == 1))
    return both.rollup("lang").agg(n().alias("n"), hit.alias("both"), F.round(hit / F.nullif(said, F.lit(0)), 6).alias("precision"), F.round(hit / F.nullif(true, F.lit(0)), 6).alias("recall")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("a15_confusion_matrix", "SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("lang").pivot("quality", [0, 1]).agg(n()).na.fill(0).withColumnsRenamed({"0": "q0", "1": "q1"})


@query("a16_contingency", "SELECT CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS verdict, count(*) FILTER (l.doc_id IS NOT NULL) AS covered, count(*) FILTER (l.doc_id IS NULL) AS open FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    both = table(spark, d, "documents").join(known, "doc_id", "left")
    return both.groupBy(F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("verdict")).agg(F.count_if(F.col("known").isNotNull()).alias("covered"), F.count_if(F.col("known").isNull()).alias("open"))


@query(
    "a17_causes_with_examples",
    """WITH c AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN text LIKE '%!!%' THEN 'shouting' WHEN contains(text, '@') THEN 'mail' ELSE 'other' END AS cause FROM documents)
    SELECT cause, count(*) AS n, list_sort(list(doc_id))[1:3] AS examples FROM c GROUP BY 1""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    cause = F.when(F.col("n_chars") < 200, "short").when(t.contains("!!"), "shouting").when(t.contains("@"), "mail").otherwise("other")
    c = table(spark, d, "documents").select("doc_id", cause.alias("cause"))
    first = c.withColumn("i", F.row_number().over(Window.partitionBy("cause").orderBy("doc_id")))
    return first.groupBy("cause").agg(n().alias("n"), F.sort_array(F.collect_list(F.when(F.col("i") <= 3, F.col("doc_id")))).alias("examples"))


@query("a18_distinct_readers", "SELECT l_partkey, count(DISTINCT l_suppkey) AS readers, list_sort(list(DISTINCT l_suppkey) FILTER (l_quantity > 40)) AS writers FROM lineitem GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    writers = F.sort_array(F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_suppkey"))))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("readers"), F.when(F.size(writers) > 0, writers).alias("writers"))


@query("a19_set_unions", "SELECT s_nationkey, list_sort(list(DISTINCT l_partkey)) AS owns FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_discount > 0.09 GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return table(spark, d, "supplier").join(li, "s_suppkey").groupBy("s_nationkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("owns"))


@query("a20_phase_combinations", "SELECT phases, count(*) AS n FROM (SELECT user_id, string_agg(event_type, '+' ORDER BY event_type) AS phases FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80) GROUP BY 1) GROUP BY 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").filter("value > 80").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("phases"))
    return by.groupBy("phases").agg(n().alias("n"))


@query("a22_first_non_empty", "SELECT conv_id, arg_min(text, turn) FILTER (length(text) > 100) AS first FROM conversations GROUP BY 1")
def a22(spark: SparkSession, d: str) -> DataFrame:
    long = F.when(F.length("text") > 100, F.col("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", long).alias("first"))


@query("a23_value_sets", "SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey)) AS nations FROM customer GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sort_array(F.collect_set("c_nationkey")).alias("nations"))


@query("a24_build_statistics", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents")
def a24(spark: SparkSession, d: str) -> DataFrame:
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    row = lambda df, name, c: df.agg(c.alias("n")).select(F.lit(name).alias("name"), "n")
    return row(docs, "documents", n()).unionAll(row(events, "events", n())).unionAll(row(docs, "languages", F.countDistinct("lang")))


@query("a25_arm_totals", "SELECT l_linestatus, sum(l_linenumber)::BIGINT AS severity, round(avg(l_extendedprice), 4) AS cost, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS trap_ratio FROM lineitem GROUP BY 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum("l_linenumber").alias("severity"), F.round(F.avg("l_extendedprice"), 4).alias("cost"), F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 6).alias("trap_ratio"))


@query("a26_tally_with_members", "SELECT quality, toxic, count(*) OVER (PARTITION BY quality, toxic) AS n, doc_id AS member FROM labels")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """A row for each member: the few counts are joined to them, so no class is gathered."""
    labels = table(spark, d, "labels")
    counts = labels.groupBy("quality", "toxic").agg(n().alias("n"))
    same = F.col("l.quality").eqNullSafe(F.col("c.quality")) & F.col("l.toxic").eqNullSafe(F.col("c.toxic"))
    return labels.alias("l").join(bounded_broadcast(counts).alias("c"), same).select("l.quality", "l.toxic", "n", F.col("doc_id").alias("member"))


@query("a27_balanced_delimiters", "SELECT page_id, length(html) - length(replace(html, '<', '')) AS opened, length(html) - length(replace(html, '>', '')) AS closed FROM pages")
def a27(spark: SparkSession, d: str) -> DataFrame:
    less = lambda c: F.length("html") - F.length(F.replace("html", F.lit(c), F.lit("")))
    return table(spark, d, "pages").select("page_id", less("<").alias("opened"), less(">").alias("closed"))


@query("a28_duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(n().alias("n")).filter("n > 1")


@query("w01_rank_in_ranking", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events")
def w01(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("w02_first_hit_rank", "SELECT user_id, min(rank) FILTER (event_type = 'purchase') AS first_hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) GROUP BY 1")
def w02(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, d, "events").withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))).alias("first_hit"))


@query("w04_next_terminator", "SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closed_by FROM events")
def w04(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w).alias("closed_by"))


@query("w07_top_per_group", "SELECT event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3")
def w07(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 3").select("event_type", "event_id", "place")


@query("w08_shared_budget", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_type, event_id) AS place FROM events WHERE value > 90) WHERE place <= 10")
def w08(spark: SparkSession, d: str) -> DataFrame:
    """At most 10 flagged rows over all groups, in the order of groups and places."""
    return table(spark, d, "events").filter("value > 90").orderBy("event_type", "event_id").limit(10).select("event_type", "event_id")


@query("w09_page_of_rows", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 40")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(40).select("o_orderkey")


@query("w10_first_mention_order", "SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def w10(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(ordered("role", "first").alias("roles"))


@query("w11_last_that_holds", "SELECT user_id, arg_max(value, event_id) FILTER (event_type <> 'error') AS value FROM events GROUP BY 1")
def w11(spark: SparkSession, d: str) -> DataFrame:
    holds = F.when(F.col("event_type") != "error", F.col("event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", holds).alias("value"))
