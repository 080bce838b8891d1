"""Licence scans by ordered signature rules, as DataFrame expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import documents
from querygavel.llm.license_rules import AFTER, BEFORE, Rule, rules

#: Everything in ASCII but digits and letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose labels always stay. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_WEIGHT = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_map(ordered: list[Rule]) -> Column:
    """Rules by keyword; a look-up gives the rules of one keyword in their order."""
    by: dict[str, list[Column]] = {}
    for r in ordered:
        by.setdefault(r.keyword, []).append(
            F.struct(
                F.lit(r.order).alias("order"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.label).alias("label"),
                F.lit(r.regex).alias("regex"),
                F.lit(r.weight).alias("weight"),
            )
        )
    return F.create_map(*[x for key, found in by.items() for x in (F.lit(key), F.array(*found))])


def _words_from(words: Column, start: Column, n: int) -> Column:
    """The n words from a place on, joined; short at the end of the text."""
    return F.array_join(F.slice(words, start + 1, F.lit(n)), " ")


def _found_at(words: Column, keyed: Column, at: Column) -> Column:
    """What the rules of the keyword at a place find: each rule once at most, around this very place."""
    first = F.greatest(at - BEFORE, F.lit(0))
    left = F.array_join(F.slice(words, first + 1, at - first), " ")
    text = F.concat(F.lit(" "), left, F.lit(" <"), _words_from(words, at, AFTER + 1), F.lit(" "))
    # An empty left side leaves two spaces; one must go.
    text = F.regexp_replace(text, "^ +", " ")

    def found(rule: Column) -> Column:
        match = F.call_function("regexp_extract", text, rule["regex"], F.lit(0))
        ahead = _spaces(F.substring_index(match, "<", 1)) - 1
        return F.struct(
            (at - ahead).alias("start"),
            (at - ahead + _spaces(match)).alias("end"),
            rule["order"].alias("order"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["weight"].alias("weight"),
            (match != "").alias("matched"),
        )

    return F.filter(F.transform(F.element_at(keyed, F.element_at(words, at + 1)), found), lambda d: d["matched"])


def _suppressed(found: Column, per_place: int) -> Column:
    """Leave out what lies within another detection of higher priority, or of the same priority and longer, or earlier
    in the order of rules. A detection reaches a few words only, so only near ones can contain it: the list is sorted by
    place, and each is compared with those around it."""
    ordered = F.array_sort(found)
    reach = (BEFORE + AFTER + 1) * per_place

    def stays(d: Column, i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(0))
        near = F.slice(ordered, low + 1, F.lit(2 * reach + 1))
        better = lambda e: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (
            (e["priority"] > d["priority"])
            | (
                (e["priority"] == d["priority"])
                & (
                    (e["end"] - e["start"] > d["end"] - d["start"])
                    | ((e["end"] - e["start"] == d["end"] - d["start"]) & (e["order"] < d["order"]))
                )
            )
        )
        return ~F.exists(near, better)

    return F.filter(ordered, stays)


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Letters A-Z count as a-z; words are runs of digits, a-z and characters beyond ASCII. Base phrases are found wherever
    their words stand one after another; their labels are never suppressed. ``detections`` holds what the rules leave:
    start and end word, label and weight. score is the largest weight of what was found, 0 for nothing.

    Null and empty texts have no words, no labels and score 0. Rows stay as they are: repeated rows give repeated
    results, null doc_ids stay null, other columns are left out. All is done within a row, in time that grows with its
    words: a text of any length is one row of one task, and nothing is shuffled.
    """
    ordered = rules() if ordered is None else ordered
    keys = sorted({r.keyword for r in ordered})
    per_place = max(sum(r.keyword == k for r in ordered) for k in keys)
    empty = F.array().cast("array<string>")
    text = F.concat(
        F.lit(" "),
        F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), SEPARATORS, " ")),
        F.lit(" "),
    )
    has_base = reduce(lambda a, b: a | b, [F.contains("padded", F.lit(f" {p} ")) for p in BASE])
    has_key = F.col("padded").rlike(" (?:" + "|".join(keys) + ")(?= )")
    split = docs.select("doc_id", text.alias("padded")).select(
        "doc_id",
        F.when(F.col("padded") == "  ", 0).otherwise(_spaces(F.col("padded")) - 1).cast("long").alias("n_words"),
        has_base.alias("has_base"),
        F.when(has_base | has_key, F.split(F.trim("padded"), " ")).otherwise(empty).alias("words"),
    )
    places = F.sequence(F.lit(0), F.size("words") - 1)
    word = lambda i: F.element_at(F.col("words"), i + 1)

    def base_places(phrase: str) -> Column:
        wanted = phrase.split(" ")
        is_here = lambda i: reduce(
            lambda a, b: a & b, [F.get(F.col("words"), i + k) == w for k, w in enumerate(wanted)]
        )
        return F.when(F.col("has_base"), F.filter(places, lambda i: F.coalesce(is_here(i), F.lit(False)))).otherwise(
            F.array().cast("array<int>")
        )

    hits = F.when(F.size("words") > 0, F.filter(places, lambda i: word(i).isin(keys))).otherwise(
        F.array().cast("array<int>")
    )
    marked = split.select(
        "doc_id", "n_words", "words", hits.alias("hits"), *[base_places(p).alias(f"base{k}") for k, p in enumerate(BASE)]
    )
    bases = [F.col(f"base{k}") for k in range(len(BASE))]
    keyed = _rule_map(ordered)
    found = marked.select(
        "doc_id",
        "n_words",
        F.sort_array(F.flatten(F.array(*bases))).alias("base"),
        F.array_sort(
            F.array_distinct(
                F.filter(
                    F.array(*[F.when(F.size(b) > 0, label) for b, label in zip(bases, BASE.values(), strict=True)]),
                    lambda x: x.isNotNull(),
                )
            )
        ).alias("base_labels"),
        F.flatten(F.transform("hits", lambda i: _found_at(F.col("words"), keyed, i))).alias("found"),
    )
    left = found.withColumn(
        "detections",
        F.transform(
            _suppressed(F.col("found"), per_place),
            lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["weight"].alias("weight")),
        ),
    )
    weights = F.transform("detections", lambda d: d["weight"])
    return left.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0)).cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"]))), ","
        ).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0.0)
        ).alias("score"),
        "detections",
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("detections")
