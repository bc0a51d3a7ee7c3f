"""Licence scan by ordered signature rules, in built-in column functions only.

A text becomes its folded words joined by single blanks. Rules (``license_rules.rules``) are tried
only where one of their gate words occurs. Every match is a detection with its place; overlapping
detections are resolved from left to right: one inside another is suppressed (of equal places the
rule of higher priority stays), and of two that overlap in part the one of higher priority stays.
Labels are those of the detections that stay, plus the base phrases' labels, which always count.

Score: 0 without a detection; otherwise the share of the longest detection's words in 8 words,
at most 1, and 0.25 at least.

Defined cases: NULL and empty texts have no words, NULL first and last word, empty labels. Rows are
judged one by one without a shuffle, so repeated rows agree and NULL ids do no harm.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.license_rules import BASE, rules
from clickfold.llm.native_words import words

def _phrase_places(phrase: str) -> Column:
    """Word indexes where the phrase starts; the positions are tried only if the phrase occurs."""
    parts = phrase.split(" ")

    def here(i):
        found = F.get("words", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get("words", i + k) == part)
        return found

    return F.when(F.contains("canon", F.lit(f" {phrase} ")),
                  F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), here)
                  ).otherwise(F.array().cast("array<int>"))


def _labelled_places(phrase: str, label: str) -> Column:
    return F.transform(_phrase_places(phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column, at: Column, add) -> Column:
    """For each item of ``sizes`` the sum of ``add`` over the items before it, plus ``at``. Every step copies the
    array, so this is for short arrays."""
    start = F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, x: F.struct(
        (acc["at"] + add(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _offsets(sizes: Column, add) -> Column:
    """``_running`` of a long array: runs of about sqrt(n) items, each from the sum of the runs before it."""
    def in_runs(run):
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / run).cast("int") - 1),
                           lambda j: F.slice(sizes, j * run + 1, run))
        total = lambda items: F.aggregate(items, F.lit(0), lambda acc, x: (acc + add(x)).cast("int"))
        return _let(runs, lambda cut: F.flatten(F.zip_with(
            cut, _running(F.transform(cut, total), F.lit(0), lambda x: x), lambda items, at: _running(items, at, add))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(
        _let(F.ceil(F.sqrt(F.size(sizes))).cast("int"), in_runs))


def _spans(rule: Column) -> Column:
    """Places (in characters) of a rule's matches: what lies between them gives their starts."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))

    def placed(found):
        between = F.slice(F.split(F.col("canon"), pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(between, found, lambda b, m: F.struct(
            F.length(b).alias("skip"), F.length(m).alias("size"), F.size(F.split(m, " ")).alias("words")))
        return _let(sizes, lambda parts: F.zip_with(
            parts, _offsets(parts, lambda x: x["skip"] + x["size"]), lambda x, at: F.struct(
                (at + x["skip"]).alias("start"), (-(at + x["skip"] + x["size"])).alias("back"),
                rule["rule"].alias("rule"), rule["label"].alias("label"), x["words"].alias("words"))))

    return _let(F.call_function("regexp_extract_all", F.col("canon"), pattern, F.lit(0)), placed)


_SPAN = "struct<start:int,back:int,rule:int,label:string,words:int>"


def _resolved(spans: Column) -> Column:
    """Labels and the most words of the detections that stay, in one sweep that holds the last of them."""
    def counted(acc):
        label = acc["last"]["label"]
        known = acc["last"].isNull() | F.array_contains(acc["labels"], label)
        labels = F.when(known, acc["labels"]).otherwise(F.concat(acc["labels"], F.array(label)))
        return labels, F.greatest(acc["longest"], F.coalesce(acc["last"]["words"], F.lit(0)))

    def state(last, labels, longest):
        return F.struct(last.alias("last"), labels.alias("labels"), longest.alias("longest"))

    def step(acc, x):
        last = acc["last"]
        clear = last.isNull() | (x["start"] >= -last["back"])
        inside = -x["back"] <= -last["back"]
        return (F.when(clear, state(x, *counted(acc)))
                .when(inside | (x["rule"] >= last["rule"]), acc)
                .otherwise(state(x, acc["labels"], acc["longest"])))

    def end(acc):
        labels, longest = counted(acc)
        return F.struct(labels.alias("labels"), longest.alias("longest"))

    none = state(F.lit(None).cast(_SPAN), F.array().cast("array<string>"), F.lit(0))
    return F.aggregate(F.array_sort(spans), none, step, end)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    table = rules()
    gates = F.from_json(F.lit(json.dumps(sorted({g for _, gate, _ in table for g in gate}))), "array<string>")
    # One literal for the whole table: a column object for each rule would take seconds to build.
    signatures = F.from_json(F.lit(json.dumps([{"rule": i, "label": label, "pattern": pattern, "gate": gate}
                                               for i, (label, gate, pattern) in enumerate(table)])),
                             "array<struct<rule:int,label:string,pattern:string,gate:array<string>>>")
    df = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    df = df.withColumn("canon", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    df = df.withColumn("gates", F.array_intersect("words", gates))
    df = df.withColumn("places", F.flatten(F.array(*(_labelled_places(*base) for base in BASE))))
    df = df.withColumn("detected", F.when(F.size("gates") > 0, F.flatten(F.transform(
        F.filter(signatures, lambda r: F.arrays_overlap(r["gate"], F.col("gates"))), _spans))))
    df = df.withColumn("stays", F.when(F.size("detected") > 0, _resolved(F.col("detected"))))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col("stays.labels"), none)
    longest = F.coalesce(F.col("stays.longest"), F.lit(0))
    df = df.withColumn("found", longest > 0).withColumn("longest", longest)
    score = F.when(~F.col("found") & (F.size("places") == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("longest") / F.lit(8.0))))
    at = F.transform("places", lambda p: p["at"])
    return df.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"),
                     F.size("places").cast("long").alias("n_base"),
                     F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
                     F.array_join(base, ",").alias("base_labels"),
                     F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
                     score.cast("double").alias("score"))
