from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from partwise.functions import tfidf as V
from partwise.operators import classify as C
from partwise.operators import dedup as J
from partwise.operators import reports as A
from partwise.plans import tfidf_sql as S
from partwise.plans.classification import CASCADE, results
from partwise.plans.registry import query
from partwise.rules.classification import FAILED
from partwise.session import stored, table

PARTS = """SELECT p_partkey AS code, replace(p_name, ' ', '') AS name, p_type || ' ' || p_brand || ' ' || p_name AS spec, p_brand AS manufacturer,
 p_type AS type, CASE WHEN p_size % 2 = 0 THEN 'pcs' ELSE '个' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 'ERP' WHEN 1 THEN 'PLM' WHEN 2 THEN 'PDM' ELSE 'WMS' END AS source
 FROM {t}"""

# Pair scores by brute force over distinct profiles. Makers are 'brand' and one or two digits, whose
# matching blocks are 'brand' and, if the digits share a character, one more.
PAIRS = ", ".join([
    f"parts AS ({PARTS.format(t='part')})",
    "prof AS (SELECT name, spec, replace(lower(manufacturer), '#', '') AS maker, type, min(code) AS node, count(*) AS n FROM parts GROUP BY ALL)",
    S.grams("n_tf", "SELECT code AS id, name AS text FROM parts", V.DEDUP_NAME), S.vocabulary("n_v", "n_tf", "SELECT count(*) FROM parts", V.DEDUP_NAME),
    S.weights("n_w", "n_tf", "n_v"),
    S.grams("s_tf", "SELECT code AS id, spec AS text FROM parts", V.DEDUP_SPEC), S.vocabulary("s_v", "s_tf", "SELECT count(*) FROM parts", V.DEDUP_SPEC),
    S.weights("s_w", "s_tf", "s_v"),
    "nc AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM n_w a JOIN n_w b USING (term) WHERE a.id IN (SELECT node FROM prof) AND b.id IN (SELECT node FROM prof) AND a.id < b.id GROUP BY 1, 2)",
    "sc AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM s_w a JOIN s_w b USING (term) WHERE a.id IN (SELECT node FROM prof) AND b.id IN (SELECT node FROM prof) AND a.id < b.id GROUP BY 1, 2)",
    """pr AS (SELECT x.node AS a, y.node AS b, x.n AS n_a, y.n AS n_b, coalesce(nc.s, 0) AS s_name, coalesce(sc.s, 0) AS s_spec,
  CASE WHEN x.maker = y.maker THEN 1.0 ELSE 2.0 * (5 + CASE WHEN contains(y.maker[6:], x.maker[6:6]) OR (length(x.maker) > 6 AND contains(y.maker[6:], x.maker[7:7])) THEN 1 ELSE 0 END)
   / (length(x.maker) + length(y.maker)) END::DOUBLE AS s_maker, CASE WHEN x.type = y.type THEN 1.0 ELSE 0.0 END::DOUBLE AS s_type,
  (CASE WHEN x.type = y.type THEN 0.5 ELSE 0 END + CASE WHEN x.maker = y.maker THEN 0.5 ELSE 0 END)::DOUBLE AS s_attributes
  FROM prof x JOIN prof y ON x.node < y.node LEFT JOIN nc ON nc.a = x.node AND nc.b = y.node LEFT JOIN sc ON sc.a = x.node AND sc.b = y.node)""",
    "allp AS (SELECT *, round(0.35 * s_name + 0.25 * s_spec + 0.15 * s_maker + 0.1 * s_type + 0.05 + 0.1 * s_attributes, 9) AS similarity FROM pr)",
    "edges AS (SELECT * FROM allp WHERE similarity >= 0.65)",
])
GROUPS = PAIRS + """, sym AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges UNION SELECT node, node FROM prof),
reach(u, v) AS (SELECT u, v FROM sym UNION SELECT reach.u, sym.v FROM reach JOIN sym ON reach.v = sym.u),
lab AS (SELECT u AS node, min(v) AS master FROM reach GROUP BY 1), memb AS (SELECT p.node, n, master FROM lab JOIN prof p USING (node)),
siz AS (SELECT master, CAST(sum(n) AS BIGINT) AS rows FROM memb GROUP BY 1 HAVING sum(n) > 1),
ps AS (SELECT x.master, sum(similarity * x.n * y.n) AS s FROM allp JOIN memb x ON x.node = a JOIN memb y ON y.node = b AND y.master = x.master GROUP BY 1),
cp AS (SELECT master, sum(n * (n - 1) / 2.0) AS s FROM memb GROUP BY 1),
sco AS (SELECT master, rows, round((coalesce(ps.s, 0) + cp.s) / (rows * (rows - 1) / 2.0), 6)::DOUBLE AS similarity FROM siz LEFT JOIN ps USING (master) JOIN cp USING (master)),
rowm AS (SELECT m.master, q.code, q.source FROM parts q JOIN prof p ON p.name = q.name AND p.spec = q.spec JOIN memb m ON m.node = p.node JOIN siz ON siz.master = m.master)"""
R = "WITH RECURSIVE "


class Run:
    """One analysis shared by the reports over it, written once to the shared folder."""

    def __init__(self, spark, d):
        df = spark.sql(PARTS.format(t="{p}"), p=table(spark, d, "part")).withColumn(
            "attributes", F.create_map(F.lit("brand"), F.col("manufacturer"), F.lit("type"), F.col("type")))
        self.df, self.spark, self.d = df, spark, d
        self.dup = J.Duplicates(df)
        self.pairs = J.cut_lineage(self.dup.pairs())
        self.groups = J.cut_lineage(self.dup.groups(self.pairs))
        self.decided = J.cut_lineage(J.decide(self.dup.group_scores(self.groups)))
        self.members = stored(J.member_rows(self.dup, self.groups), "members")
        self.catalog = table(spark, d, "part").select(
            F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("name"), F.lit("").alias("spec"),
            F.when(F.expr("p_name LIKE '%ring'"), F.lit("rings")).otherwise(F.col("p_type")).alias("category"))

    def enriched(self):
        keys = self.df.join(self.decided.select(F.col("master").alias("code")), "code", "left_semi").select(
            F.col("code").alias("master"), "name", F.lit("").alias("spec"))
        return J.enrich_groups(self.decided, keys, self.catalog)

    def recommended(self):
        masters = self.decided.select(F.col("master").alias("item_id"))
        answers = C.priority_cascade(*results(self.spark, self.d, masters)).filter(F.col("category") != FAILED)
        return J.recommend_actions(self.enriched(), answers.select(F.col("item_id").alias("master"), "category"))


@lru_cache(maxsize=2)
def run(spark, d):
    return Run(spark, d)


def six(c):
    return F.round(c, 6).alias(c)


@query("j11_type_unit_attributes", """
SELECT l_orderkey, l_linenumber, CASE WHEN lower(l_returnflag) = lower(l_linestatus) THEN 1.0 ELSE 0.0 END::DOUBLE AS s_type,
 CASE WHEN (CASE l_linenumber % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN '个' ELSE 'KG' END) IN ('pcs', '个') THEN 1.0 ELSE 0.0 END::DOUBLE AS s_unit,
 ((CASE WHEN l_tax = l_discount THEN 1 ELSE 0 END + CASE WHEN l_linestatus = l_returnflag THEN 1 ELSE 0 END) / 2.0)::DOUBLE AS s_attributes FROM lineitem""")
def j11(spark, d):
    li = table(spark, d, "lineitem")
    a = F.create_map(F.lit("rate"), F.col("l_tax").cast("string"), F.lit("flag"), F.col("l_returnflag"), F.lit("own"), F.lit("x"))
    b = F.create_map(F.lit("flag"), F.col("l_linestatus"), F.lit("rate"), F.col("l_discount").cast("string"))
    unit = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN '个' ELSE 'KG' END")
    return li.select("l_orderkey", "l_linenumber", J.equal_filled(F.lower("l_returnflag"), F.lower("l_linestatus")).alias("s_type"),
                     J.equal_filled(J.canonical_unit(unit), J.canonical_unit(F.lit("件"))).alias("s_unit"), J.attribute_similarity(a, b).alias("s_attributes"))


@query("j12_pair_similarity", f"WITH {PAIRS} SELECT a, b, n_a, n_b, round(s_name, 6) AS s_name, round(s_spec, 6) AS s_spec, round(s_maker, 6) AS s_maker, round(similarity, 6) AS similarity FROM edges")
def j12(spark, d):
    p = run(spark, d).pairs
    return p.select("a", "b", F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), six("s_name"), six("s_spec"), six("s_maker"), six("similarity"))


@query("j13_components", f"{R}{GROUPS} SELECT code, master FROM rowm")
def j13(spark, d):
    return run(spark, d).members.select("code", "master")


DECIDE = """CASE WHEN similarity >= 0.85 THEN 'auto_merge' WHEN similarity >= 0.65 THEN 'manual_review' ELSE 'separate' END"""


@query("j14_group_scores", f"{R}{GROUPS} SELECT master, rows, similarity, {DECIDE} AS action, similarity < 0.85 AS review_required FROM sco")
def j14(spark, d):
    return run(spark, d).decided.select("master", "rows", six("similarity"), "action", "review_required")


@query("j15_group_tables", f"{R}{GROUPS} SELECT md5(CAST(master AS VARCHAR)) AS group_id, master AS master_code, code, source, similarity AS similarity_score, 'pending' AS status FROM rowm JOIN sco USING (master)")
def j15(spark, d):
    r = run(spark, d)
    groups, rows = J.persist_tables(r.decided, r.members)
    return groups.join(rows, "group_id").select("group_id", "master_code", "code", "source", six("similarity_score"), "status")


ENRICH = GROUPS + """, keyn AS (SELECT master, q.name FROM sco JOIN parts q ON q.code = master),
hit AS (SELECT master, CASE WHEN p_name LIKE '%ring' THEN 'rings' ELSE p_type END AS category FROM keyn JOIN part ON contains(replace(p_name, ' ', ''), name)),
cat AS (SELECT master, string_agg(DISTINCT category, '|' ORDER BY category) AS cats, count(DISTINCT category) AS k FROM hit GROUP BY 1),
enr AS (SELECT master, rows, CASE WHEN k = 1 THEN least(similarity + 0.1, 1.0) ELSE similarity END AS similarity, CASE WHEN k = 1 THEN 'merge_with_existing' ELSE """ + DECIDE + """ END AS action, cats, k
  FROM sco LEFT JOIN cat USING (master))"""


@query("j16_catalog_enrichment", f"{R}{ENRICH} SELECT master, round(similarity, 6) AS similarity, action, cats AS categories FROM enr")
def j16(spark, d):
    return run(spark, d).enriched().select("master", six("similarity"), "action", F.array_join("existing_categories", "|").alias("categories"))


RECOMMEND = ENRICH + f""", rec AS (SELECT master, rows, similarity, CASE WHEN similarity >= 0.85 THEN 'auto_merge' WHEN similarity >= 0.75 THEN 'manual_review' ELSE 'separate' END AS action,
 CASE WHEN similarity >= 0.85 THEN 'high' WHEN similarity >= 0.75 THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN k = 1 THEN 'merge_to_existing' WHEN k > 1 THEN 'resolve_conflicts' WHEN answer IS NOT NULL THEN 'new_classification' ELSE 'manual_classification' END AS integration_type,
 CASE WHEN k = 1 THEN cats WHEN k IS NULL THEN answer END AS suggested_category FROM enr LEFT JOIN (WITH {CASCADE} SELECT item_id, category AS answer FROM cas WHERE category <> '{FAILED}') ON item_id = master)"""


@query("j17_actions", f"{R}{RECOMMEND} SELECT master, action, priority, integration_type, suggested_category FROM rec")
def j17(spark, d):
    return run(spark, d).recommended().select("master", "action", "priority", "integration_type", "suggested_category")


@query("j18_source_scope", f"""{R}{GROUPS} SELECT master, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) AS rows,
 CASE WHEN count(DISTINCT source) > 1 THEN 'cross_source' ELSE 'single_source' END AS scope FROM rowm GROUP BY 1""")
def j18(spark, d):
    return J.split_by_source(run(spark, d).members).withColumn("sources", F.array_join("sources", "|"))


@query("j19_merge_map", f"""{R}{GROUPS}, req AS (SELECT s_suppkey AS master FROM supplier)
SELECT master, code AS merged_code, 'merged' AS status FROM req JOIN rowm USING (master) WHERE code <> master
UNION ALL SELECT master, CAST(NULL AS BIGINT), 'not_found' FROM req WHERE master NOT IN (SELECT master FROM siz)""")
def j19(spark, d):
    req = table(spark, d, "supplier").select(F.col("s_suppkey").alias("master"))
    return J.merge_map(run(spark, d).members, req)


BUCKETS = "count(*) FILTER (WHERE similarity >= 0.85) AS high, count(*) FILTER (WHERE similarity >= 0.65 AND similarity < 0.85) AS medium, count(*) FILTER (WHERE similarity < 0.65) AS low"


@query("a01_dedup_report", f"{R}{GROUPS} SELECT source, count(*) AS total_groups, round(avg(similarity), 6) AS avg_confidence, {BUCKETS} FROM sco JOIN parts ON code = master GROUP BY 1")
def a01(spark, d):
    r = run(spark, d)
    g = r.decided.join(r.df.select(F.col("code").alias("master"), "source"), "master").withColumn("similarity", F.round("similarity", 6))
    return A.dedup_report(g, "source").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("a02_dedup_statistics", f"""{R}{GROUPS} SELECT source, count(*) AS total, count(*) FILTER (WHERE code IN (SELECT code FROM rowm)) AS involved,
 (SELECT round(count(*) FILTER (WHERE code <> master) * 1.0 / (SELECT count(*) FROM parts), 6) FROM rowm)::DOUBLE AS duplication_rate FROM parts GROUP BY 1""")
def a02(spark, d):
    r = run(spark, d)
    return A.dedup_statistics(r.df, r.decided, r.members).withColumn("duplication_rate", F.round("duplication_rate", 6))


@query("a03_action_summary", f"""{R}{RECOMMEND} SELECT count(*) FILTER (WHERE action = 'auto_merge') AS auto_merge, count(*) FILTER (WHERE action = 'manual_review') AS manual_review,
 count(*) FILTER (WHERE action = 'separate') AS separate, count(*) AS total_groups FROM rec""")
def a03(spark, d):
    return A.action_summary(run(spark, d).recommended())


@query("a04_master_dashboard", "SELECT count(*) AS total, count(DISTINCT p_type) AS categories, count(DISTINCT p_brand) AS makers FROM part")
def a04(spark, d):
    return A.master_dashboard(table(spark, d, "part"), "p_type", "p_brand")


@query("a05_value_counts", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
def a05(spark, d):
    return A.value_counts(table(spark, d, "part"), "p_type")


@query("a06_platform_statistics", """
WITH f AS (SELECT count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS rows, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR) AS last_24h FROM orders)
SELECT 'files' AS metric, files AS value FROM f UNION ALL SELECT 'rows', rows FROM f UNION ALL SELECT 'last_24h', last_24h FROM f
UNION ALL SELECT 'type_' || event_type, count(*) FROM events GROUP BY 1""")
def a06(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("rows"), F.col("o_orderdate").alias("uploaded_at"))
    results = table(spark, d, "events").select(F.col("event_type").alias("kind"))
    return A.platform_statistics(files, results, F.expr("timestamp_ntz'1998-06-01'"))


@query("a07_training_statistics", """
SELECT (SELECT count(*) FROM part) AS samples, (SELECT count(DISTINCT p_type) FROM part) AS categories, (SELECT count(DISTINCT p_brand) FROM part) AS brands,
 count(DISTINCT user_id) AS sessions, count(*) FILTER (WHERE event_type = 'click') AS active_models FROM events""")
def a07(spark, d):
    samples = table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    sessions = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_type") == "click").alias("is_active"))
    return A.training_statistics(samples, sessions)


@query("a09_retention", """
SELECT (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY) AS deleted,
 (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 10 DAY) AS kept_results""")
def a09(spark, d):
    files = table(spark, d, "orders").select(F.lit(False).alias("is_deleted"), F.col("o_orderdate").alias("uploaded_at"))
    results = table(spark, d, "events").select(F.col("ts").alias("created_at"))
    kept, _ = A.retention(files, results, F.expr("timestamp_ntz'1998-06-01'"), 30)
    _, left = A.retention(files, results, F.expr("timestamp_ntz'2024-01-25'"), 10)
    return kept.agg(F.count_if("is_deleted").alias("deleted")).crossJoin(left.agg(F.count("*").alias("kept_results")))


@query("a11_latest_per_key", "SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a11(spark, d):
    e = table(spark, d, "events")
    return A.latest(e, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "event_type")
