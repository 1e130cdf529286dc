"""Allow and block rules for URLs, looked up by hashed host-suffix and path-prefix expressions.

A rule is a host and the beginning of a path. It fits a URL whose host is the rule's or a
subdomain of it and whose path begins with the rule's. Every URL is expanded into the
expressions that a rule could equal (only in shapes that some rule has: so many labels, so
many path characters), the expressions are joined with the rules on a short hash prefix, and
the full digest confirms the match. The longest rule wins; of two equally long ones the one
with the longer host, of the same rule twice the blocking one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import ascii_lower


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path behind it up to ``?`` or ``#``.

    Both are empty where the URL is null or has no ``://``.
    """
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


#: Hex digits of the prefix that is joined on.
SHORT = 8


def _hashed(expression: Column) -> Column:
    digest = F.sha2(expression, 256)
    return F.struct(F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url", default: str = "allow",
          broadcast_rules: int = 100_000, salts: int = 16) -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``urls``; other columns of ``urls`` are ignored.

    ``rules`` has host, path (empty or beginning with ``/``) and action (allow or block); rows
    with a null are skipped. URLs that no rule fits get a null rule and ``default``. Up to
    ``broadcast_rules`` rules (counted first) are broadcast; more are joined by a shuffle in
    which a hot expression is dealt over ``salts`` tasks. Null, empty and repeated URLs are
    kept, each row with its own verdict; empty tables give empty results.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("action")).dropna()
    length, host_length = F.length("rule_host") + F.length("rule_path"), F.length("rule_host")
    # Rank and winner in one number: total length, host length, blocking bit.
    rank = (F.shiftleft(length.cast("long"), 32) + F.shiftleft(host_length.cast("long"), 1) + (F.col("action") == "block").cast("long"))
    table = rules.select(_hashed(F.concat("rule_host", "rule_path")).alias("h"), rank.alias("rank"),
                         F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))
    # A shape is a number of labels and a number of path characters, so there are few however many rules there are.
    shapes = table.select("labels", "chars").distinct().orderBy("labels", "chars").collect()
    table = table.groupBy("h.short", "h.digest").agg(F.max("rank").alias("rank"))
    # The join is on the short prefix; of the few rules that share one, the full digest tells.
    table = table.groupBy("short").agg(F.collect_list(F.struct("digest", "rank")).alias("rules"))

    host, path = host_and_path(url_col)
    base = urls.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")

    def expression(s: Column) -> Column:
        return _hashed(F.concat(F.array_join(F.slice(labels, -s["labels"], s["labels"]), "."), F.substring(F.col("path"), 1, s["chars"])))

    # One literal array that every row filters by its own lengths: the plan is as small for a thousand shapes as for one.
    all_shapes = F.from_json(F.lit(json.dumps([s.asDict() for s in shapes])), "array<struct<labels:int,chars:int>>")
    fitting = F.filter(all_shapes, lambda s: (F.size(labels) >= s["labels"]) & (F.length("path") >= s["chars"]))
    tried = F.transform(fitting, expression)
    rows = base.select(id_col, "_url", "host", "path", F.posexplode_outer(tried).alias("pos", "e"))
    rows = rows.select(id_col, "_url", "host", "path", (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("first"), "e.short", "e.digest")
    if rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        hit = rows.join(F.broadcast(table), "short", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "_url"), F.lit(salts)))
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        hit = rows.join(table, ["short", "salt"], "left")
    hit = hit.withColumn("rank", F.get(F.filter("rules", lambda r: r.digest == F.col("digest")), F.lit(0))["rank"])
    best = hit.groupBy(id_col, "_url", "host", "path").agg(F.max("rank").alias("rank"), F.sum("first").alias("copies"))
    whole, host_part = F.shiftright("rank", 32).cast("int"), F.shiftright(F.col("rank").bitwiseAND((1 << 32) - 1), 1).cast("int")
    # The winner's text is the end of the host and the beginning of the path, whose lengths the rank holds.
    best = best.withColumns({"n_host": host_part, "n_path": whole - host_part})
    rule = F.when(F.col("rank").isNotNull(), F.expr("concat(right(host, n_host), left(path, n_path))"))
    verdict = F.when(F.col("rank").isNull(), F.lit(default)).when(F.col("rank").bitwiseAND(1) == 1, "block").otherwise("allow")
    return best.select(F.col(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.explode(
        F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
