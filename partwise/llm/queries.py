"""Registered queries of the training-data operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.llm import fingerprints, language, merkle, mixing, packing, pivots, quality, rollups, simhash_tiles, spelling, toxicity, url_rules, warc
from partwise.llm.common import bucket_of, table, written
from partwise.plans.registry import Query
from partwise.session import scratch_path

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


#: Fixed values of the rule query: action, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"),
         ("block", "org", "/es/")]

VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)

OP7_SQL = """
WITH rules(action, rhost, rpath) AS (VALUES %s),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hits AS (
  SELECT rid, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rid)
""" % VALUES


@query("op7_url_rules", OP7_SQL)
def op7(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES %s AS r(action, host, path)" % VALUES)
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, "page_id")


@query("op6_simhash_fingerprints")
def op6(spark, sf_dir):
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_simhash_near_duplicates")
def op9(spark, sf_dir):
    found = simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fixed values of the mixing query: weights in turn, share of all words, largest multiple of a source; and its curriculum.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))

@query("op8_curriculum_mixing")
def op8(spark, sf_dir):
    """What is taken of each document, in the order of its first copy."""
    docs = table(spark, sf_dir, "documents")
    return mixing.taken_in_order(docs, mixing.mix(docs, WEIGHTS, SHARE, CAP, SCHEDULES))


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of("doc_id", 5) == 0
    filters = language.learn(docs.filter(~held_out))
    found = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), language.identify(filters, docs).alias("l"))
    return found.select("doc_id", "held_out", "l.*")


@query("op3_toxicity_machine")
def op3(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    machine = toxicity.learn(docs, labels.filter(bucket_of("doc_id", 5) != 0))
    scored = docs.select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxicity.toxicity(machine, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op4_quality_ridge")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    described = written(docs.select("doc_id", quality.statistics_column().alias("stats")), "statistics")
    model = quality.learn(described, table(spark, sf_dir, "labels").filter(bucket_of("doc_id", 4) != 2))
    scored = described.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), quality.quality(model, described).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op1_pivot_near_duplicates")
def op1(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH changed AS (
  SELECT source, lang, coalesce(text, '') AS text,
         CASE WHEN strpos(text, chr(10)) > 0 THEN left(text, length(text) - length(split_part(text, chr(10), -1)) - 1) ELSE coalesce(text, '') END AS final
  FROM documents),
kept AS (SELECT source, lang, final FROM changed WHERE length(final) >= 200)
SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens FROM (
  SELECT source, lang, 'words-v1' AS tokenizer, len(regexp_extract_all(final, '[^\\x20\\x09-\\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-v2', len(regexp_extract_all(final, '[\\p{L}\\p{M}]+|\\p{N}+|[^\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]')) FROM kept)
GROUP BY ALL
"""


@query("op5_token_rollups", OP5_SQL)
def op5(spark, sf_dir):
    """Three batches over the whole table: all documents arrive, those of several lines lose the last one, short ones go; one comes twice."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.col("text").cast("string").alias("text"))
    cut = F.when(F.instr("text", "\n") > 0, F.expr("left(text, length(text) - length(substring_index(text, '\n', -1)) - 1)")).otherwise(F.coalesce("text", F.lit("")))
    none = F.lit(None).cast(rollups.STATE)
    old, new = rollups.state(F.col("source"), F.col("lang"), F.col("text")), rollups.state(F.col("source"), F.col("lang"), cut)
    several = docs.filter(F.instr("text", "\n") > 0)
    batches = {1: docs.select(none.alias("before"), old.alias("after")), 2: several.select(old.alias("before"), new.alias("after")),
               3: docs.filter(F.length(cut) < 200).select(new.alias("before"), none.alias("after"))}
    store = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    for batch in (1, 2, 2, 3):
        store.commit(batch, rollups.deltas(batches[batch], {"words-v1": rollups.words, "pieces-v2": rollups.pieces}))
    return store.totals()


#: crc32 of a string's bytes in SQL: a table of 256 from its polynomial, then one look-up per byte.
CRC_SQL = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of ``text``; reads ``tab`` of the table above."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _tree_sql(name: str, leaves: str) -> str:
    """A tree over ``leaves`` (part, pos, h, n) as ``<name>``, and each node's siblings as ``<name>_sib``."""
    run = "PARTITION BY lvl, part, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""
{name} AS (SELECT 0 AS lvl, part, pos, h, n FROM {leaves} UNION ALL
  SELECT lvl + 1, part, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lvl, part, pos // 3, n),
{name}_sib AS (SELECT lvl, part, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, source AS part, {_leaf_sql("text")} AS leaf,
  CASE WHEN ({crc32_sql("doc_id::VARCHAR")}) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS altered FROM documents, crc),
p AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM d),
{_tree_sql("t", "p")},
s AS (SELECT 0 AS part, part AS of_part, h, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree_sql("u", "s")},
f AS (SELECT rid, part, 0 AS lvl, pos, coalesce(altered, leaf) AS h, '' AS proof FROM p UNION ALL
  SELECT rid, f.part, f.lvl + 1, pos // 3, sha256(l || h || r), proof || l || r FROM f JOIN t_sib b USING (pos) WHERE b.lvl = f.lvl AND b.part IS NOT DISTINCT FROM f.part),
g AS (SELECT rid, 0 AS lvl, s.pos, f.h, proof FROM (SELECT *, max(lvl) OVER (PARTITION BY rid) AS top FROM f) f JOIN s ON f.part IS NOT DISTINCT FROM s.of_part WHERE lvl = top UNION ALL
  SELECT rid, g.lvl + 1, pos // 3, sha256(l || h || r), proof || l || r FROM g JOIN u_sib b USING (pos) WHERE b.lvl = g.lvl),
e AS (SELECT rid, max_by(h, lvl) AS folded_root, sha256(max_by(proof, lvl)) AS proof_sha256 FROM g GROUP BY rid)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON p.part IS NOT DISTINCT FROM s.of_part JOIN e USING (rid)
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    """Every document against the manifest of the untouched table; where the id's crc32 is even, its line ends were taken out on the way."""
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.when(bucket_of("doc_id", 2) == 0, merkle.leaf(*values, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    found = merkle.manifest(docs, "source", "doc_id", merkle.leaf(*values, F.col("text")), altered)
    folded = merkle.folded(F.coalesce("altered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
             row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS least FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('%s', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - i %% 4 * 5)) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to
FROM p
""" % warc.BASE32


@query("op12_warc_round_trip", OP12_SQL)
def op12(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html", least_bytes=0)


OP13_SQL = f"""
WITH {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, k, {crc32_sql("key")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT * FROM w WHERE length(word) >= 7 AND n >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
s AS (SELECT DISTINCT v.word AS less, v.n AS less_n, x.word AS more, x.n AS more_n FROM x JOIN v ON x.cut = v.word),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION ALL SELECT less, less_n, more, more_n FROM s UNION ALL SELECT more, more_n, less, less_n FROM s),
b AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (word)),
g AS (SELECT word, word AS place, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON g.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, max_by(place, step) AS root, n, n_near, form_n FROM f JOIN g ON f.word = g.word GROUP BY f.word, form, n, n_near, form_n
""".replace("WITH", "WITH RECURSIVE", 1)


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))
