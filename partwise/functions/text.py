"""Tokens, n-grams, regex extraction, fingerprints and content hashes as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.rules import extraction as X

WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
HAN = r"\x{4e00}-\x{9fff}"
#: Chinese has no spaces: every two neighbouring characters of a run, and the other words of two characters or more, in text order.
#: The tokens overlap, so they are captured (group 1) by a look-ahead.
SEGMENTS = rf"(?=([{HAN}]{{2}}|(?<![\p{{L}}\p{{N}}_&&[^{HAN}]])[\p{{L}}\p{{N}}_&&[^{HAN}]]{{2,}}))"


def tokens(text: Column, pattern: str = WORD, group: int = 0) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(group))


def ngrams(words: Column, most: int) -> list[Column]:
    """Runs of 1..most consecutive words joined by a space, one array per length.

    ``words`` should be a plain column: each length zips shifted slices of it.
    """
    runs = [words]
    for k in range(2, most + 1):
        shifted = F.slice(words, F.lit(k), F.greatest(F.size(words) - (k - 1), F.lit(0)))
        before = F.slice(runs[-1], F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))
        runs.append(F.zip_with(before, shifted, lambda x, y: F.concat_ws(" ", x, y)))
    return runs


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    """One pass over the text for all words."""
    return c.rlike("|".join(re.escape(w) for w in words))


def first_contained(c: Column, rules: list[tuple[list[str], object]], default=None) -> Column:
    """Value of the first rule one of whose words the text contains."""
    out = None
    for words, value in rules:
        out = F.when(contains_any(c, words), F.lit(value)) if out is None else out.when(contains_any(c, words), F.lit(value))
    return out.otherwise(F.lit(default))


def first_match(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """The first pattern's first match, as a whole; null when none matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, flags + p, 0), F.lit("")) for p in patterns])


def latin_runs(c: Column) -> Column:
    """What LATIN_RUN finds without case, by splitting.

    The JVM regex engine recurses once per word of a run, which a long text overflows.
    """
    lone = F.regexp_replace(c, "(?<![A-Za-z])[A-Za-z](?![A-Za-z])", "|")
    return F.filter(F.split(lone, r"[^A-Za-z\s]+"), lambda x: F.length(strip(x)) > 0)


def all_matches(c: Column, patterns: list[tuple[str, int]], flags: str = "(?i)") -> Column:
    """Every match of every pattern, trimmed and distinct, in first-seen order."""
    found = F.flatten(F.array(*[
        latin_runs(c) if p == X.LATIN_RUN else F.regexp_extract_all(c, F.lit(flags + p), F.lit(g)) for p, g in patterns]))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def remove_all(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: F.replace(a, F.lit(w), F.lit("")), words, c)


def name_fingerprint(name: Column) -> Column:
    """Lower-cased, noise words out, remaining words sorted and joined."""
    bare = remove_all(F.lower(F.trim(F.coalesce(name, F.lit("")))), X.NAME_NOISE)
    words = F.regexp_extract_all(bare, F.lit(r"[\x{4e00}-\x{9fa5}a-zA-Z0-9]+"), F.lit(0))
    return F.array_join(F.array_sort(words), "")


def spec_fingerprint(spec: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    parts = [F.regexp_extract_all(s, F.lit(p), F.lit(g)) for p, g in ((X.NUM, 0), (X.SPEC_UNITS, 1), (X.SPEC_MARKS, 1))]
    return F.array_join(F.array_sort(F.concat(*parts)), "")


def maker_fingerprint(maker: Column) -> Column:
    bare = remove_all(F.lower(F.trim(F.coalesce(maker, F.lit("")))), X.COMPANY_SUFFIXES)
    return F.regexp_replace(bare, r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]", "")


def combined_fingerprint(name: Column, spec: Column, maker: Column) -> Column:
    return F.md5(F.concat_ws("|", name_fingerprint(name), spec_fingerprint(spec), maker_fingerprint(maker)))


def content_hash(fields: dict[str, Column]) -> Column:
    """md5 of canonical JSON of the business fields: sorted names, trimmed and lower-cased, blanks left out."""
    def clean(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.lower(F.trim(c)))

    return F.md5(F.to_json(F.struct(*[clean(fields[f]).alias(f) for f in sorted(X.HASH_FIELDS) if f in fields])))


def record_hash(columns: list[str]) -> Column:
    """md5 of canonical JSON of every column but the timestamps."""
    kept = sorted(c for c in columns if c not in X.TIMESTAMP_FIELDS)
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in kept])))


def last_modified(columns: list[str], now: Column) -> Column:
    """First parseable of the known time fields, else ``now``."""
    known = [F.col(c).cast("string").try_cast("timestamp_ntz") for c in X.MODIFIED_FIELDS if c in columns]
    return F.coalesce(*known, now)


def baseline_category(name: Column) -> Column:
    return first_contained(name, [([w], v) for w, v in X.BASELINE_CATEGORIES], X.BASELINE_DEFAULT)
