from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.plans.registry import query
from partwise.session import scratch_path, table
from partwise.sources import readers as R
from partwise.sources import writers as K
from partwise.sources.adapters import load, register_adapter

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


@query("s01_csv_scan", "SELECT * FROM customer")
def s01(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").write.csv(path, header=True, sep=";")
    return R.read_csv(spark, path, CUSTOMER, sep=";")


def arrays_of_records(df, key, size=500):
    """Text lines that each hold a JSON array of at most ``size`` consecutive keys."""
    return df.groupBy(F.floor(F.col(key) / size).alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))


@query("s02_json_records_scan", "SELECT * FROM customer")
def s02(spark, d):
    path = scratch_path(spark, "json")
    arrays_of_records(table(spark, d, "customer"), "c_custkey").select("value").write.text(path)
    return R.read_json_records(spark, path, CUSTOMER)


@query("s03_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s03(spark, d):
    return R.read_parquet(spark, f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s04_api_payload_unwrap", "SELECT * FROM supplier")
def s04(spark, d):
    path = scratch_path(spark, "payload")
    chunks = arrays_of_records(table(spark, d, "supplier"), "s_suppkey", 7)
    wrapped = F.format_string('{"status":"ok","data":%s}', "value")
    single = F.regexp_replace("value", r"^\[|\]$", "")
    body = F.when(F.size(F.from_json("value", "array<struct<s_suppkey:bigint>>")) == 1, single).otherwise(wrapped)
    chunks.select(body.alias("value")).write.text(path)
    return R.unwrap_payload(spark.read.text(path), "value", T._parse_datatype_string(SUPPLIER))


@query("s05_table_conditions", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def s05(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("pw_orders")
    found = R.read_table(spark, "pw_orders", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("s06_parameterised_query", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-01-01'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def s06(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("pw_orders")
    text = """SELECT o_orderkey, o_totalprice FROM pw_orders
              WHERE o_orderstatus = :status AND o_orderdate >= cast(:since AS timestamp_ntz)
              ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"""
    return R.read_query(spark, text, {"status": "P", "since": "1998-01-01"})


def embedded_database() -> tuple[str, dict]:
    """A new in-memory database of the JVM, as a stand-in for a remote one."""
    return f"jdbc:derby:memory:pw{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("s07_ranged_read", """
SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def s07(spark, d):
    """A database table read in eight ranges of its key at once."""
    url, driver = embedded_database()
    n = K.write_jdbc(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), url, "CUSTOMER", "replace", driver)
    got = R.read_partitioned(spark, {"url": url, **driver}, "CUSTOMER", "c_custkey", 0, n, 8)
    return got.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("s05_jdbc_conditions", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderkey IS NOT NULL""")
def s05_jdbc(spark, d):
    """The database form of the table read; the condition is evaluated by the database."""
    url, driver = embedded_database()
    K.write_jdbc(table(spark, d, "orders").select("o_orderkey", "o_custkey"), url, "ORDERS", "replace", driver)
    return R.read_table(spark, "ORDERS", {"o_custkey": 7}, {"url": url, **driver})


@query("s08_document_find", """
SELECT CAST(doc_id AS VARCHAR) AS _id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY 1 LIMIT 20""")
def s08(spark, d):
    path = scratch_path(spark, "docs")
    table(spark, d, "documents").withColumnRenamed("doc_id", "_id").write.json(path)
    docs = spark.read.json(path, schema="_id bigint, text string, lang string, source string, n_chars bigint")
    return R.find_documents(docs, {"lang": "en", "source": "src3"}, 20).select("_id", "source", "n_chars")


@query("s09_table_info", """
SELECT v.position, v.column_name, v.data_type, n.row_count FROM (VALUES
 (0,'o_orderkey','bigint'),(1,'o_custkey','bigint'),(2,'o_orderstatus','string'),(3,'o_totalprice','double'),
 (4,'o_orderdate','timestamp_ntz'),(5,'o_orderpriority','string')) v(position, column_name, data_type),
 (SELECT count(*) AS row_count FROM orders) n""")
def s09(spark, d):
    return R.table_info(table(spark, d, "orders")).drop("nullable")


@query("s10_tolerant_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS code, c_name || CASE WHEN c_custkey % 97 = 1 THEN '法兰' ELSE '' END AS name, c_mktsegment AS segment FROM customer""")
def s10(spark, d):
    """A folder of files in two encodings, in which few lines are not ASCII."""
    @F.arrow_udf("binary")
    def gbk(values):
        return pa.array([v.encode("gbk") for v in values.to_pylist()], pa.binary())

    path = scratch_path(spark, "tolerant")
    c = table(spark, d, "customer").select(
        F.pmod("c_custkey", F.lit(4)).alias("p"), F.concat_ws("|", "c_custkey", F.concat("c_name", F.when(F.pmod("c_custkey", F.lit(97)) == 1, "法兰").otherwise("")), "c_mktsegment").alias("line"))
    head = c.select("p").distinct().select("p", F.lit(" code | name|segment ").alias("line"), F.lit(0).alias("at"))
    lines = head.unionByName(c.withColumn("at", F.lit(1))).repartition(4, "p").sortWithinPartitions("p", "at")
    # The text writer takes a string's bytes as they are.
    lines.select("p", F.when(F.col("p") == 1, gbk("line").cast("string")).otherwise(F.col("line")).alias("line")).write.partitionBy("p").text(path)
    return R.read_csv_tolerant(spark, path + "/*")


@query("s11_preamble_skip", "SELECT s_suppkey, s_name FROM supplier")
def s11(spark, d):
    path = scratch_path(spark, "preamble")
    s = table(spark, d, "supplier")
    part = F.pmod("s_suppkey", F.lit(4)).alias("p")
    line = F.concat_ws(",", "s_suppkey", "s_name")
    # Four files, each opening with six free lines and a header, as exported spreadsheets do.
    lead = s.select(part).distinct().select("p", F.posexplode(F.split(F.lit("title|date|user|-|-|-|code,name"), r"\|")).alias("at", "value"))
    body = s.select(part, F.lit(7).alias("at"), line.alias("value"))
    lines = lead.unionByName(body).repartition(4, "p").sortWithinPartitions("p", "at")
    lines.select("p", "value").write.partitionBy("p").text(path)
    return R.read_after_preamble(spark, path + "/*", 6, T._parse_datatype_string("s_suppkey bigint, s_name string"))


@query("k01_file_sink", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def k01(spark, d):
    out = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    path = K.write_file(out, scratch_path(spark, "sink") + "_{timestamp}", "csv")
    return R.read_csv(spark, path, "segment string, n bigint")


@query("k02_table_sink", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def k02(spark, d):
    """Replace followed by append in a database table."""
    url, driver = embedded_database()
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    K.write_jdbc(s.filter("s_acctbal < 0"), url, "SUPPLIER", "replace", driver)
    K.write_jdbc(s.filter("NOT s_acctbal < 0"), url, "SUPPLIER", "append", driver)
    return R.read_table(spark, "SUPPLIER", jdbc={"url": url, **driver}).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("k03_keyed_upsert", """
WITH batch AS (SELECT o_custkey AS code, o_orderstatus AS status, o_orderkey AS seq FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT * FROM batch UNION ALL
SELECT c_custkey, 'new', CAST(-1 AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT code FROM batch)""")
def k03(spark, d):
    target = table(spark, d, "customer").select(
        F.col("c_custkey").alias("code"), F.lit("new").alias("status"), F.lit(-1).cast("bigint").alias("seq"))
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("code"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return K.upsert(target, rows, ["code"], [F.col("seq")])


@query("k03_bucketed_upsert", """
WITH o AS (SELECT o_custkey AS code, o_orderstatus AS status, o_orderkey AS seq, o_orderkey % 2 AS half FROM orders),
one AS (SELECT code, status, seq FROM o WHERE half = 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq DESC) = 1),
two AS (SELECT code, status, seq FROM o WHERE half = 1 AND code % 3 = 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq DESC) = 1)
SELECT * FROM two UNION ALL SELECT * FROM one WHERE code NOT IN (SELECT code FROM two)
UNION ALL SELECT c_custkey, 'new', CAST(-1 AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT code FROM one) AND c_custkey NOT IN (SELECT code FROM two)""")
def k03_bucketed(spark, d):
    """Two commits and one delivered twice; each rewrites the buckets of its own keys."""
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.lit("new").alias("status"), F.lit(-1).cast("bigint").alias("seq"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    stored = K.KeyedTable(spark, scratch_path(spark, "keyed"), ["code"], 16)
    stored.create(target)
    first, second = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1 AND code % 3 = 0")
    for name, part in (("first", first), ("second", second), ("first", first)):
        stored.commit(name, part, [F.col("seq")])
    return stored.read().select("code", "status", "seq")


@query("k04_insert_if_absent", """
WITH e AS (SELECT user_id AS record_id, event_type AS source_system, md5(props) AS content_hash, min(event_id) AS first_id
           FROM events GROUP BY 1,2,3),
t AS (SELECT user_id AS record_id, event_type AS source_system, md5(props) AS content_hash, min(event_id) AS first_id
      FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1,2,3)
SELECT * FROM t UNION ALL
SELECT u.* FROM (SELECT user_id AS record_id, event_type AS source_system, md5(props) AS content_hash, min(event_id) AS first_id
  FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1,2,3) u
 ANTI JOIN t USING (record_id, source_system, content_hash)""")
def k04(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("source_system"), F.md5("props").alias("content_hash"),
        F.col("event_id").alias("first_id"), "ts")
    keys = ["record_id", "source_system", "content_hash"]
    early = K.first_per_key(e.filter("ts < timestamp_ntz'2024-01-15'").drop("ts"), keys, [F.col("first_id")])
    late = e.filter("ts >= timestamp_ntz'2024-01-15'").drop("ts")
    return K.insert_if_absent(early, late, keys, [F.col("first_id")])


@query("k05_replace_for_key", """
WITH new AS (SELECT o_custkey AS category_id, o_orderpriority AS feature,
   CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS display_order
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT c_custkey AS category_id, c_mktsegment AS feature, 1 AS display_order FROM customer
 WHERE c_custkey NOT IN (SELECT category_id FROM new)
UNION ALL SELECT * FROM new""")
def k05(spark, d):
    target = table(spark, d, "customer").select(
        F.col("c_custkey").alias("category_id"), F.col("c_mktsegment").alias("feature"), F.lit(1).alias("display_order"))
    lists = (
        table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1998-01-01'")
        .groupBy(F.col("o_custkey").alias("category_id"))
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("feature")))).alias("l"))
        .select("category_id", F.transform("l", lambda x: F.struct(x["feature"].alias("feature"))).alias("items"))
    )
    return K.replace_for_key(target, lists, "category_id", "items")


@query("k06_nested_export", """
SELECT c_custkey AS session_id, c_name AS name, coalesce(count(o_orderkey), 0) AS n_results,
       coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS results
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def k06(spark, d):
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("name"))
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "export")
    K.nest_stages(sessions, {"results": results}, "session_id").write.json(path)
    back = spark.read.json(path, schema="session_id bigint, name string, results array<struct<o_orderkey:bigint,o_orderstatus:string>>")
    items = F.coalesce("results", F.array())
    shown = F.transform(items, lambda r: F.concat_ws(":", r["o_orderkey"], r["o_orderstatus"]))
    return back.select("session_id", "name", F.size(items).cast("bigint").alias("n_results"), F.array_join(shown, ",").alias("results"))


@query("u03_source_adapter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def u03(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("pw_supplier")
    register_adapter("suppliers_of", lambda s, nation: R.read_table(s, "pw_supplier", {"s_nationkey": nation}))
    return load(spark, "suppliers_of", 3).select("s_suppkey", "s_name")
