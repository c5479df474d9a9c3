"""License scans by ordered signature rules (native: SQL expressions only).

A text's words (lower-cased, all but letters, digits and non-ASCII removed)
are joined by single spaces. Each of the rules (license_rules) runs only on texts
that hold its keyword, and yields spans. A span is suppressed when another span of
at least its priority contains it: of equal spans the one with higher
priority, then the earlier rule, stays. What is left gives the labels.

Suppression sorts the spans of a document by start and compares each with the
furthest end so far of every priority, so its cost is that of a sort, and only the spans
of texts that have any are shuffled.

Defined results: null text counts as empty; a text without words has n_words
0 and no labels (empty strings); repeated rows give equal results; an empty
table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_or_empty
from .license_rules import rules

#: What stands between words; upper-case letters are part of words and lower-cased later.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), an array, with the value computed once and not at each use inside a lambda."""
    return F.flatten(F.transform(F.array(value), body))


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, as word numbers."""
    parts = phrase.split()

    def here(w: Column, i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.get(w, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])

    return _bind(words, lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: here(w, i)))


def _trie(words: list[str]) -> str:
    """A regex for any of the words (as prefixes) that reads each character once."""
    if "" in words:
        return ""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(by_first.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _spans(joined: Column) -> Column:
    """array<struct<lens, p, rule, label, conf>> of all rules whose keyword the text holds.

    Every rule's regex is a constant of the plan, so that it is compiled once, not
    for every text; only what a rule found is looked at by a lambda.
    """
    by_keyword: dict[str, list[Column]] = {}
    for i, label, kw, rx, p, c in rules():
        found = F.regexp_extract_all(joined, F.lit(rx), F.lit(0))
        by_keyword.setdefault(kw, []).append(F.struct(found.alias("m"), F.lit(rx).alias("rx"), F.lit(p).alias("p"), F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(c).alias("conf")))
    held = F.flatten(F.array_compact(F.array(*[F.when(F.contains(joined, F.lit(kw)), F.array(*r)) for kw, r in by_keyword.items()])))

    def place(z: Column) -> Column:
        # the k-th match stands after the k-th gap
        lens = _bind(F.split(joined, z["rx"], -1), lambda gaps: F.transform(z["m"], lambda m, k: F.struct(F.char_length(F.get(gaps, k)).alias("g"), F.char_length(m).alias("l"))))
        return F.struct(lens.alias("lens"), z["p"].alias("p"), z["rule"].alias("rule"), z["label"].alias("label"), z["conf"].alias("conf"))

    return F.transform(F.filter(held, lambda z: F.size(z["m"]) > 0), place)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    t = text_or_empty(text)
    words = df.select(F.col(key).alias("key"), F.xxhash64(t).alias("h"), F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), BETWEEN, " ").alias("w"))
    # lower() also changes non-ASCII letters: good enough for the gate, which it can only widen
    gate = F.lower("w").rlike(" " + _trie(sorted({r[2] for r in rules()})))
    n_words = F.char_length("w") - F.char_length(F.replace("w", F.lit(" "), F.lit(""))) - 1
    joined = words.select("key", "h", n_words.cast("long").alias("n_words"), F.when(gate, ascii_lower(F.col("w"))).alias("j"))
    none = F.array().cast("array<int>")
    base = [F.when(F.contains(F.col("j"), F.lit(f" {p} ")), _places(F.split(F.trim("j"), " "), p)).otherwise(none).alias(f"b{i}") for i, (p, _) in enumerate(BASE)]
    spans = F.when(F.col("j").isNotNull(), _spans(F.col("j")))
    flat = materialize(joined.select("key", "h", "n_words", *base, spans.alias("spans")), "license")

    found = flat.where(F.size("spans") > 0).select("key", "h", F.explode("spans").alias("r"))
    places = found.select("key", "h", "r.p", "r.rule", "r.label", "r.conf", F.posexplode("r.lens").alias("k", "x"))
    so_far = Window.partitionBy("key", "h", "rule", "label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # repeated rows have the same spans: one of each is enough
    places = places.dropDuplicates(["key", "h", "rule", "k"])
    end = F.sum(F.col("x.g") + F.col("x.l")).over(so_far)
    spanned = places.withColumn("e", end).withColumn("s", F.col("e") - F.col("x.l"))
    before = Window.partitionBy("key", "h").orderBy(F.col("s"), F.desc("e"), F.desc("p"), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    furthest = [F.max(F.when(F.col("p") >= level, F.col("e"))).over(before) for level in (1, 2, 3)]
    reach = F.when(F.col("p") == 1, furthest[0]).when(F.col("p") == 2, furthest[1]).otherwise(furthest[2])
    kept = spanned.withColumn("reach", reach).where(F.coalesce(F.col("reach") < F.col("e"), F.lit(True)))
    labels = kept.groupBy("key", "h").agg(F.collect_set("label").alias("extra"), F.max("conf").alias("score"))
    labels = labels.select(F.col("key").alias("_k"), F.col("h").alias("_h"), "extra", "score")

    all_places = reduce(F.concat, [F.col(f"b{i}") for i in range(len(BASE))])
    named = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    out = flat.join(labels, F.col("key").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "key",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("extra", empty))), ",").alias("labels"),
        F.coalesce("score", F.when(F.size(named) > 0, F.lit(0.6)), F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")
