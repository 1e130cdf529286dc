"""Material grades in a name: hits, the name without them, and the confidence bonus they give a category."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import contains_any
from partwise.rules import grades as G


HITS = ("array<struct<detected:string,base:string,weight:double,category:string,grade:string,confidence:double,"
        "removals:array<string>>>")


def dictionary() -> list[tuple[str, tuple]]:
    """(keyword or lower-cased alias, grade row), longest first."""
    entries = {}
    for row in G.GRADES:
        entries[row[0]] = row
        for alias in row[4]:
            entries[alias.lower()] = row
    return sorted(entries.items(), key=lambda e: -len(e[0]))


def _search_pattern(keyword: str) -> str:
    k = re.escape(keyword.lower())
    return rf"(?U)\b{k}\b|{k}(?=不锈钢|钢|合金|$)|(?<![a-z]){k}(?![a-z])"


def _removal_pattern(word: str) -> str:
    k = re.escape(word)
    return rf"(?iU)\b{k}\b|{k}(?=不锈钢|钢|合金)|(?<![a-z]){k}(?![a-z])"


@cache
def _hits_sql() -> str:
    """Every dictionary entry as a searched struct over the bound text ``low``; built once, parsed as one expression."""
    context = f"CASE WHEN low RLIKE '{'|'.join(G.CONTEXT_WORDS)}' THEN 0.05D ELSE 0D END"
    entries = []
    for keyword, (base, weight, category, grade, aliases) in dictionary():
        removals = ", ".join(f"r'{_removal_pattern(w)}'" for w in [keyword, *aliases])
        entries.append(
            f"CASE WHEN low RLIKE r'{_search_pattern(keyword)}' THEN named_struct('detected', '{keyword}', 'base', '{base}', 'weight', {weight}D, "
            f"'category', '{category}', 'grade', '{grade}', 'confidence', least(1D, 0.8D + CASE WHEN contains(low, '{keyword}') THEN 0.1D ELSE 0D END + {context}), "
            f"'removals', array({removals})) END")
    return f"array_compact(array({', '.join(entries)}))"


def grade_hits(name: str) -> Column:
    """One hit per base grade of the named column, found by its longest keyword: array of structs, longest keyword first."""
    # A fold, so that the searches run once and only the kept hits are looked at again.
    return F.expr(f"""aggregate(
        get(transform(array(lower(trim(coalesce({name}, '')))), low -> {_hits_sql()}), 0),
        cast(array() AS {HITS}),
        (kept, h) -> CASE WHEN exists(kept, k -> k.base = h.base) THEN kept ELSE concat(kept, array(h)) END)""")


def weight_sum(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["weight"])


def categories(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["category"])))


def core_concept(name: Column, hits: Column) -> Column:
    """The name without its grade words and modifiers; the uncleaned rest when nothing would remain."""
    def drop(acc: Column, hit: Column) -> Column:
        return F.trim(F.aggregate(hit["removals"], acc, lambda a, p: F.regexp_replace(a, p, F.lit(""))))

    rest = F.aggregate(hits, name, drop)
    spaced = reduce(lambda a, words: F.regexp_replace(a, rf"(?iU)\b({'|'.join(words)})\b", " "), G.MODIFIERS, rest)
    squeezed = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    bare = F.regexp_replace(squeezed, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.when(bare != "", bare).otherwise(rest)


def bonus(hits: Column, category: Column) -> Column:
    """Confidence bonus of the detected grades for a category, at most 0.3."""
    by_grade = F.create_map(*[F.lit(x) for kv in G.GRADE_BONUS.items() for x in kv])
    total = F.aggregate(hits, F.lit(0.0), lambda a, h: a + F.coalesce(by_grade[h["grade"]], F.lit(G.OTHER_GRADE_BONUS)))
    for material, targets, gain in G.CATEGORY_BONUS:
        has = F.exists(hits, lambda h: h["category"] == material)
        total = total + F.when(has & contains_any(category, targets), gain).otherwise(0.0)
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.least(total, F.lit(G.MAX_BONUS)))
