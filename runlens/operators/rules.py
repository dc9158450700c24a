"""Many rules with several premises at once: facts meet an index of the rules, and partial matches grow with new facts.

Rules are rows ``rule, slot, predicate``: one premise each, in the order of ``slot``. They are tried from the last slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.joins import salted_join
from runlens.operators.ordered import GROUP_LIMIT
from runlens.session import keep

# Slots that one number of a partial match holds, as bits.
WORD = 32


@dataclass(frozen=True)
class RuleIndex:
    """``slots``: predicate → shape, size, word, bit. ``members``: rule, shape. Rules with equal premises share a shape."""

    slots: DataFrame
    members: DataFrame
    rows: int


def rule_index(rules: DataFrame) -> RuleIndex:
    """The index of ``rules``; repeated rows count once, a NULL predicate is a slot that no fact fills.

    One rule's premises are gathered in a list: a rule is as long as somebody wrote it, whatever the number of rules.
    """
    ordered = F.array_sort(F.collect_list(F.struct("slot", "predicate")))
    listed = rules.select("rule", "slot", "predicate").distinct().groupBy("rule").agg(
        F.transform(ordered, lambda s: s["predicate"]).alias("premises")
    )
    listed = keep(listed, "rules")
    shapes = listed.groupBy("premises").agg(F.min("rule").alias("shape"))
    place = F.col("_place")
    slots = shapes.select(
        "shape", F.size("premises").alias("size"), F.posexplode(F.reverse("premises")).alias("_place", "predicate")
    ).select(
        "predicate", "shape", "size", F.floor(place / WORD).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, _place % {WORD})").alias("bit"),
    )
    slots = keep(slots.filter(F.col("predicate").isNotNull()), "slots")
    return RuleIndex(slots, keep(listed.join(shapes, "premises").select("rule", "shape"), "members"), slots.count())


def partial_matches(facts: DataFrame, index: RuleIndex, binding: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """``binding, shape, size, word, filled``: the slots that ``facts`` (binding, ``predicate``) fill, as bits.

    All rules are matched in one pass. Equal facts leave first; the index is broadcast up to ``limit`` rows, and a
    longer one meets the facts in a join that cuts hot predicates. Bits are or-ed before the shuffle, so a binding that
    holds a large share of the facts sends a row per task and rule.
    """
    seen = facts.select(*binding, "predicate").distinct()
    if index.rows <= limit:
        met = seen.join(F.broadcast(index.slots), "predicate")
    else:
        met = salted_join(seen, index.slots, ["predicate"], limit=limit)
    return met.groupBy(*binding, "shape", "size", "word").agg(F.bit_or("bit").alias("filled"))


def grown(partial: DataFrame, facts: DataFrame, index: RuleIndex, binding: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """``partial`` after more ``facts``: only these meet the index. Facts that were there already change nothing."""
    both = partial.unionByName(partial_matches(facts, index, binding, limit))
    return keep(both.groupBy(*binding, "shape", "size", "word").agg(F.bit_or("filled").alias("filled")), "partial")


def depths(partial: DataFrame, index: RuleIndex, binding: Sequence[str]) -> DataFrame:
    """``binding, rule, depth, matched`` for every rule of which a binding fills a slot; all others have depth 0.

    ``depth`` is the number of filled slots from the last one to the first gap.
    """
    # The lowest ones of a number: x xor x + 1 has one bit more.
    def ones(x):
        return F.bit_count(x.bitwiseXOR(x + F.lit(1).cast("long"))) - 1

    words = F.array_sort(F.collect_list(F.struct("word", "filled")))
    depth = F.aggregate(
        "_words", F.lit(0), lambda d, w: F.when(d == w["word"] * WORD, d + ones(w["filled"])).otherwise(d)
    )
    found = partial.groupBy(*binding, "shape", "size").agg(words.alias("_words")).withColumn("depth", depth)
    return found.join(index.members, "shape").select(*binding, "rule", "depth", (F.col("depth") == F.col("size")).alias("matched"))


def match_rules(facts: DataFrame, rules: DataFrame, binding: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """``depths`` of all ``rules`` over ``facts``."""
    index = rule_index(rules)
    return depths(partial_matches(facts, index, binding, limit), index, binding)
