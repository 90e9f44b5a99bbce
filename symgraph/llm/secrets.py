"""Secret scan over a trigram inverted index (DataFrame functions only).

Each rule's regular expression yields a Boolean query over trigrams that a match must
hold. The index lists, for every such trigram, the documents that hold it; posting lists
are intersected per alternative, and only surviving (document, rule) pairs are verified
with the expression itself. A rule without a mandatory trigram scans every document.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """kind names the spans; least is the length that group `group` of a match needs."""

    kind: str
    pattern: str
    least: int
    group: int = 0


# The three base expressions, and well-known public token formats after them.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (Rule("assign", ASSIGN, 6, 2), Rule("access", "AKIA[A-Z0-9]+", 20), Rule("hex", "[0-9a-f]+", 24))
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{15,}", 20),
    Rule("google", "AIza[0-9A-Za-z_-]{35,}", 39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
RULES = BASE + MORE


#: Matches whose offsets are summed in one go; see _matches.
RUN = 128


def _sums(lengths: Column, start) -> Column:
    """Running totals of an array of lengths, each total counting its own element, from start on."""
    empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(lengths, empty, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends")))


def _matches(text: Column, rule: Rule) -> Column:
    """Spans of leftmost non-overlapping matches as (start, end), long enough ones only.

    split() returns what lies between matches and regexp_extract_all() the matches, so a
    match ends where all gaps and matches up to it end. Lengths count code points. Running
    totals append to an array, so they go in runs of RUN, the runs' own totals ahead of
    them: a text with n matches costs about n * RUN + (n / RUN)^2 copied numbers, not n^2.
    """
    pattern = _tight(rule)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    steps = F.zip_with(gaps, F.transform(found, F.length), lambda g, m: g + F.coalesce(m, F.lit(0)))
    runs = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(RUN)), lambda i: F.slice(steps, i, RUN))
    offsets = _sums(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)), F.lit(0))["ends"]
    ends = F.flatten(F.transform(runs, lambda r, k: _sums(r, F.when(k > 0, F.get(offsets, k - 1)).otherwise(0))["ends"]))
    spans = F.zip_with(F.arrays_zip(F.transform(found, F.length).alias("m"), F.transform(parts, F.length).alias("p")), ends, lambda s, end: F.struct((end - s["m"]).alias("start"), end.alias("end"), s["p"].alias("size")))
    return F.filter(spans, lambda s: s["size"] >= rule.least)


def _ranked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _tight(rule: Rule) -> str:
    """The rule's expression with the least length in it where that changes no match that is long enough.

    That holds for a head of letters that all belong to the one greedy class behind it: a
    match cut off for its length holds no longer one. Others stay as they are.
    """
    if rule.group or not rule.pattern.endswith("]+"):
        return rule.pattern
    head, tail = rule.pattern[: rule.pattern.rindex("[")], rule.pattern[rule.pattern.rindex("[") : -1]
    if not re.fullmatch(f"(?:{tail})*", head):
        return rule.pattern
    return f"{head}{tail}{{{max(1, rule.least - len(head))},}}"


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the trigrams that the rules' queries name; texts are lower-cased."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for g in clause})
    known = F.array(*[F.lit(g) for g in grams])
    held = F.transform(F.array(F.lower(text_col)), lambda low: F.filter(known, lambda g: low.contains(g)))[0]
    return docs.select(F.col(id_col).alias("id"), F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, mask): bit i is set where the postings of some alternative of rule i intersect in that document."""
    spark = postings.sparkSession
    wanted = [{"trigram": g, "rule": i, "clause": j, "need": len(clause)} for i, r in enumerate(rules) for j, clause in enumerate(trigram_query(r.pattern)) for g in clause]
    # A few rows per rule, out of a literal: rows handed over by createDataFrame start Python workers on the executors.
    plan = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(wanted)), "array<struct<trigram:string,rule:int,clause:int,need:int>>"))))
    return (
        postings.distinct().join(plan, "trigram")
        .groupBy("id", "rule", "clause", "need").agg(F.count("*").alias("n"))
        .where("n = need")
        .groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with `secret_spans`, an array of (start, rank, kind, end) in code points.

    Spans are ordered by start, then by the order of the rules. A null text has no spans;
    null ids are searched like others; rows that repeat an id are each verified on their
    own text. An empty table stays empty. Other columns pass through, but for one named
    secret_spans, which is replaced.
    """
    docs = docs.drop("secret_spans")
    ids = candidates(trigram_index(docs, rules, id_col, text_col), rules).select(F.col("id").alias("__secrets_id"), F.col("mask").alias("__secrets_mask"))
    joined = docs.join(ids, docs[id_col].eqNullSafe(ids["__secrets_id"]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    per_rule = []
    for i, rule in enumerate(rules):
        indexed = bool(trigram_query(rule.pattern))
        wanted = text.rlike(_tight(rule))
        if indexed:
            wanted = (F.coalesce(F.col("__secrets_mask"), F.lit(0)).bitwiseAND(1 << i) != 0) & wanted
        per_rule.append(F.when(wanted, F.transform(_matches(text, rule), _ranked(i, rule.kind))).otherwise(none))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*per_rule))).drop("__secrets_id", "__secrets_mask")


def describe(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by the mark; overlapping spans become one."""
    start = "named_struct('pos', 0, 'out', '')"
    walked = F.aggregate(
        spans,
        F.expr(start),
        lambda acc, s: F.when(
            s["start"] >= acc["pos"],
            F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(walked["out"], F.substring(text, walked["pos"] + 1, F.length(text))))
