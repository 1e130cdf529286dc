"""Spelling variants by a relational trie walk.

Two words that differ by one code point agree on their first or on their second half. So there is
a trie of the words and one of the reversed words, and an edit is looked for only behind the half
that agrees: every word enters each trie at the node of that half, with no hot root above it.
Only nodes that matter are kept, where words enter, end or part; an edge's label is the text
between two of them. The states are (word, position, node, edits). States without an edit are
the nodes on the word's own path; there it meets the other children, whose first code point
differs from the word's next one, and one edit brings it past their label or drops it. States
with their edit spent follow the single edge that fits, level by level, until none is left. A
state that is at the end of its word and on a node where a word ends is a pair of neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import ascii_lower, text_of, written

#: Prefixes longer than this name their node by a digest.
LONG = 64
#: A node tells its next so many code points, so that states that cannot go on are not kept.
AHEAD = 2


def _node(reverse: Column, prefix: Column) -> Column:
    name = F.when(F.length(prefix) <= LONG, prefix).otherwise(F.concat(F.lit("#"), F.sha2(prefix, 256)))
    return F.concat(F.when(reverse, F.lit("<")).otherwise(F.lit(">")), name)


def _after(text: Column, n: Column | int) -> Column:
    """The text without its first n code points."""
    return F.substring(text, (F.lit(n) if isinstance(n, int) else n) + 1, F.length(text))


def vocabulary(documents: DataFrame, id_col: str, text_col: str, letters: str, modulus: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n): the runs of ``letters`` of all texts, A-Z lower-cased, with their number of occurrences.

    If ``modulus`` divides h, the crc32 of ``<id>:<run>``, the run loses its code point h mod length.
    Shorter words than ``least_length`` and rarer ones than ``least_count`` are left out.
    """
    runs = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(letters), F.lit(0))).alias("run"))
    # A run never grows, so shorter ones need no checksum.
    runs = runs.filter(F.length("run") >= least_length).select(ascii_lower(F.col("run")).alias("run"), "id")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), _after(F.col("run"), at + 1))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of all words and the distributed edge table of both tries.

    Paths are (word, reverse, start, text, path), one row per word and direction: the kept nodes
    struct(l, node, ends) in order, with the length of the prefix and the count of the word that
    ends there. Edges are (node, first, label, ahead, ends), one row per kept node with a kept
    node above it; ``ahead`` lists the next two code points below it.
    """
    both = words.withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("len", F.length("word"))
    half = F.floor(F.col("len") / 2).cast("int")
    # A word is entered by words of one code point less or more, too; the first half rounds down, the second up.
    both = both.select("word", "n", "reverse", "len", F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")).alias("text"),
                       F.when(F.col("reverse"), F.col("len") - half).otherwise(half).alias("start"),
                       F.when(F.col("reverse"), half).otherwise(F.floor((F.col("len") - 1) / 2).cast("int")).alias("least"))
    rows = both.withColumn("l", F.explode(F.sequence("least", "len"))).withColumn("node", _node(F.col("reverse"), F.substring("text", F.lit(1), F.col("l"))))
    nodes = rows.select("node", F.substring("text", F.col("l") + 1, F.lit(AHEAD)).alias("next"), (F.col("l") == F.col("start")).alias("entered"), F.when(F.col("l") == F.col("len"), F.col("n")).alias("ends"))
    nodes = nodes.groupBy("node").agg(F.collect_set("next").alias("ahead"), F.max("entered").alias("entered"), F.max("ends").alias("ends"))
    parts = F.size(F.array_distinct(F.transform("ahead", lambda x: F.substring(x, 1, 1)))) > 1
    kept = written(nodes.filter(F.col("entered") | F.col("ends").isNotNull() | parts).select("node", F.concat(F.lit(","), F.array_join("ahead", ","), F.lit(",")).alias("ahead"), "ends"), "trie_nodes")
    paths = rows.select("word", "reverse", "start", "text", "l", "node").join(kept.select("node", "ends"), "node").groupBy("reverse", "word").agg(
        F.first("start").alias("start"), F.first("text").alias("text"), F.sort_array(F.collect_list(F.struct("l", "node", "ends"))).alias("path"))
    paths = written(paths, "trie_paths")
    steps = F.transform(F.slice("path", F.lit(2), F.size("path")), lambda below, i: F.struct(
        F.get("path", i).node.alias("node"), below.node.alias("child"), F.substring(F.col("text"), F.get("path", i).l + 1, below.l - F.get("path", i).l).alias("label")))
    # Every word below a node tells of the same edge.
    edges = paths.select(F.explode(steps).alias("e")).select("e.*").groupBy("child").agg(F.first("node").alias("node"), F.first("label").alias("label"))
    edges = edges.join(kept.withColumnRenamed("node", "child"), "child").select("node", F.substring("label", F.lit(1), F.lit(1)).alias("first"), "label", "ahead", "ends")
    return paths, written(edges, "trie_edges")


def _alive() -> Column:
    """At the end of the word and of another one, or with its next code points below the node."""
    return F.when(F.col("rest") == "", F.col("ends").isNotNull()).otherwise(F.instr("ahead", F.concat(F.lit(","), F.substring("rest", F.lit(1), F.lit(AHEAD)), F.lit(","))) > 0)


def _edited(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, reverse, rest, made, ends): states behind one edit. ``rest`` is what is left of the word, ``made`` the text on the way to the node."""
    own = paths.withColumn("at", F.explode(F.filter("path", lambda p: p.l >= F.col("start"))))
    own = own.select("word", "reverse", F.col("at.node").alias("node"), F.col("at.ends").alias("node_ends"),
                     _after(F.col("text"), F.col("at.l")).alias("rest"), F.substring("text", F.lit(1), F.col("at.l")).alias("made"))
    own = own.withColumn("next", F.substring("rest", F.lit(1), F.lit(1)))
    # The last code point is one too many.
    dropped = own.filter((F.length("rest") == 1) & F.col("node_ends").isNotNull()).select("word", "reverse", F.lit("").alias("rest"), "made", F.col("node_ends").alias("ends"))
    met = own.drop("node_ends").join(edges, "node").filter(F.col("first") != F.col("next"))
    label, rest, size = F.col("label"), F.col("rest"), F.length("label")
    tail = _after(label, 1)
    replaced = F.when((rest != "") & (F.substring(rest, F.lit(2), size - 1) == tail), _after(rest, size))
    inserted = F.when(F.substring(rest, F.lit(1), size - 1) == tail, _after(rest, size - 1))
    deleted = F.when(F.substring(rest, F.lit(2), size) == label, _after(rest, size + 1))
    met = met.withColumn("left", F.explode(F.array(replaced, inserted, deleted))).filter("left IS NOT NULL")
    met = met.select("word", "reverse", F.col("left").alias("rest"), F.concat("made", "label").alias("made"), "ends", "ahead").filter(_alive()).drop("ahead")
    return dropped.unionByName(met)


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level down, along the edge whose label comes next."""
    going = states.drop("ends").withColumns({"node": _node(F.col("reverse"), F.col("made")), "first": F.substring("rest", F.lit(1), F.lit(1))})
    met = going.join(edges, ["node", "first"]).filter(F.startswith("rest", "label"))
    return met.select("word", "reverse", _after(F.col("rest"), F.length("label")).alias("rest"), F.concat("made", "label").alias("made"), "ends", "ahead").filter(_alive()).drop("ahead")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n; distinct words) that differ by exactly one inserted, deleted or replaced code point."""
    paths, edges = _trie(words)
    states = written(_edited(paths, edges), "trie_states")
    found = states
    while not (going := states.filter("rest <> ''")).isEmpty():
        states = written(_followed(going, edges), "trie_states")
        found = found.unionByName(states)
    near = found.filter("rest = ''").select("word", "reverse", F.when(F.col("reverse"), F.reverse("made")).otherwise(F.col("made")).alias("near"), F.col("ends").alias("near_n"))
    # A pair that agrees on both halves (one code point inserted in the middle) is met in both tries.
    half = F.floor(F.length("word") / 2).cast("int")
    first = F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half)
    return near.filter(~F.col("reverse") | ~first).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words with a form; the way is followed by doubling, and as counts grow tenfold at each step it is short."""
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = written(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        way = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return way


def variants(words: DataFrame, times: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of ``words`` (word, n; distinct words).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is at
    least ``times`` the word's, else null; ``times`` is at least 2, so forms never go round. ``root``
    is where the forms lead from the word, itself if it has none. Empty input gives no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
    rows = written(rows.select("word", F.when(F.col("fits"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = r"[A-Za-zÀ-ÿ]+", modulus: int = 31,
                   least_length: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """Spelling variants among the words of whole texts; see ``vocabulary`` and ``variants``.

    Null and empty texts have no words; a null id reads as the empty text in the checksum; repeated
    rows count each; ties go by code-point order; words of any length are kept whole, at a cost
    that grows with the square of the longest; an empty table gives no rows; other columns are
    ignored, whatever their names. Words shorter than two code points are never compared.
    """
    words = written(vocabulary(documents, id_col, text_col, letters, modulus, max(2, least_length), least_count), "words")
    return variants(words, times)
