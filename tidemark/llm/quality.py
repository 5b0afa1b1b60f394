"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a condition that rejects a row. A sample tells every rule's cost (seconds to evaluate
it) and selectivity (share of rows that it rejects); the rules then run in the order of rejections
per cost, as one CASE, so that a row which a cheap rule rejects never pays for the dear ones. A row
is kept if no rule rejects it, so the verdict is the same for every order and every sample.

Null and empty texts have no words. Repeated rows and null ids each get their own row. Extra
columns stay, but for those with the name of an output, which it replaces. Conditions that are null don't reject. An empty table keeps the given order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, table, words

#: Rows at most in the sample that orders the rules. It has no part in any verdict.
SAMPLE_ROWS = 300


class Rule(NamedTuple):
    name: str
    #: From the features by name to the condition that rejects.
    rejects: Callable[[Mapping[str, Column]], Column]


#: The base rules, and those of the method. Integer arithmetic, so that SQL engines agree.
BASE = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
MORE = (
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("same_lines", lambda f: let(f["lines"], lambda x: 2 * x["same"] > x["n"])),
    Rule("capitals", lambda f: 10 * f["n_capitals"] > 4 * f["word_chars"]),
    Rule("word_length", lambda f: (f["word_chars"] < 3 * f["n_words"]) | (f["word_chars"] > 10 * f["n_words"])),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once even where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that an array of words has twice or more, first included."""
    same = lambda w, x, y: (x["h"] == y["h"]) & (F.get(w, x["i"]) == F.get(w, y["i"])) & (F.get(w, x["i"] + 1) == F.get(w, y["i"] + 1)) & (F.get(w, x["i"] + 2) == F.get(w, y["i"] + 2))
    windows = lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    twice = lambda w, s: F.filter(s, lambda x, j: F.coalesce(same(w, x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(w, x, F.get(s, j - 1)), F.lit(False)))
    at = lambda w: let(windows(w), lambda s: F.sort_array(F.transform(twice(w, s), lambda x: x["i"])))
    new = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last"))
    count = F.aggregate(at(w), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), new)["n"]
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(count)


def text_features(text: Column, w: Column | None = None) -> dict[str, Column]:
    """Every feature as an expression of the text, and of its words w where they are at hand."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return {
        "n_words": F.size(words(text) if w is None else w).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("same"))),
        "n_repeat_words": let(words(text), repeat_words) if w is None else repeat_words(w),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
    }


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, lines (n, same), n_dup_lines, n_repeat_words in place of columns
    of these names; the text is split once."""
    both, made = free_name("_both", docs), free_name("_lines", docs)
    f = text_features(F.col(text_col))
    pair = let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    cells = docs.withColumns({both: pair, made: f["lines"], "word_chars": f["word_chars"], "n_symbols": f["n_symbols"]})
    out = {"n_words": F.col(f"{both}.n"), "n_repeat_words": F.col(f"{both}.r"), "lines": F.col(made), "n_dup_lines": F.col(f"{made}.same")}
    return cells.withColumns(out).drop(both, made)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to `rows` rows, about one in sixteen, by a hash of what can be hashed (maps can't)."""
    mixed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())])
    return docs.where(mixed.bitwiseAND(F.lit(15)) == 0).limit(rows)


def in_order(sample: DataFrame, rules: list[tuple[str, Column]]) -> list[str]:
    """The names of the rules by rejections per second on a sample, best first. A job costs something without any
    rule as well: only what a rule adds counts as its cost."""
    sample = sample.persist()

    def seconds(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, hits

    try:
        if not sample.count():
            return [name for name, _ in rules]
        nothing = min(seconds(F.lit(False))[0] for _ in range(2))
        worth = []
        for k, (name, rejects) in enumerate(rules):
            (first, hits), (again, _) = seconds(rejects), seconds(rejects)
            worth.append((-hits / max(min(first, again) - nothing, 1e-4), k, name))
    finally:
        sample.unpersist()
    return [name for _, _, name in sorted(worth)]


def verdict(rules: list[tuple[str, Column]], names: list[str]) -> Column:
    """True if no rule holds; the rules are asked in the order of names, up to the first that does."""
    out, known = None, dict(rules)
    for name in names:
        out = F.when(known[name], False) if out is None else out.when(known[name], False)
    return F.lit(True) if out is None else out.otherwise(True)


def cascade(docs: DataFrame, rules: list[tuple[str, Column]], out: str = "kept", sample: DataFrame | None = None) -> DataFrame:
    """docs with the boolean out (in place of a column of that name): true if no rule (name, condition that
    rejects) holds. sample: rows with the columns that the rules read; by default some of docs."""
    return docs.withColumn(out, verdict(rules, in_order(sample_of(docs) if sample is None else sample, rules)))


def bound(rules: tuple[Rule, ...], features: Mapping[str, Column]) -> list[tuple[str, Column]]:
    return [(r.name, r.rejects(features)) for r in rules]


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs. Words are split once, before the rules."""
    text = F.col(text_col)
    sample = sample_of(docs.select(text.alias("text"))).select("text", words(F.col("text")).alias("w"))
    names = in_order(sample, bound(rules, text_features(F.col("text"), F.col("w"))))
    return docs.where(let(words(text), lambda w: verdict(bound(rules, text_features(text, w)), names)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs, sample = base_columns(source), base_columns(sample_of(source))
    own = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")}
    features = text_features(F.col("text")) | own
    judged = cascade(docs, bound(BASE + MORE, features), sample=sample)
    failed = F.lit(False)
    for _, rejects in bound(BASE, features):
        failed = failed | rejects
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)
), again AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), f AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals
  FROM s LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_capitals > 4 * word_chars
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM b
"""

QUERIES = {"op5_quality": op5_quality}
ORACLES = {"op5_quality": OP5_SQL}
