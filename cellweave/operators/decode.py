"""Barcode decoding: base calls from intensities, colour codes, codebooks, rules and gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import l2_normalised

# The example three-colour table of base pairs.
COLOURS = {
    "AA": 1, "AC": 2, "AG": 3, "AT": 4, "CA": 2, "CC": 1, "CG": 4, "CT": 3,
    "GA": 3, "GC": 4, "GG": 1, "GT": 2, "TA": 4, "TC": 3, "TG": 2, "TT": 1,
}


def call_bases(spots: DataFrame, intensity: str = "intensity") -> DataFrame:
    """ARR01-ARR04, STR12, AGG33: spots with an array of rounds of channel intensities get per-round colours (the
    1-based brightest channel; -1 on a tie), qualities (-log of the normalised maximum; infinite on a tie), the mean
    quality, the mean margin between the two brightest channels, the largest intensity and the barcode."""
    rounds = F.transform(intensity, lambda c: l2_normalised(c))
    spots = spots.withColumn("_rounds", rounds)
    tie = lambda c: F.size(F.filter(c, lambda x: x == F.array_max(c))) > 1
    colours = F.transform("_rounds", lambda c: F.when(tie(c), F.lit(-1).cast("long")).otherwise(F.array_position(c, F.array_max(c))))
    quality = F.transform("_rounds", lambda c: F.when(tie(c), F.lit(float("inf"))).otherwise(-F.ln(F.array_max(c))))
    margin = F.transform("_rounds", lambda c: F.element_at(F.sort_array(c, asc=False), 1) - F.element_at(F.sort_array(c, asc=False), 2))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    called = spots.withColumn("colours", colours).withColumn("qualities", quality).withColumn("margin", mean(margin))
    called = called.withColumn("quality", mean(F.col("qualities"))).withColumn("valid", F.forall("colours", lambda x: x > 0))
    brightest = F.array_max(F.transform(intensity, F.array_max))
    barcode = F.array_join(F.transform("colours", lambda x: F.when(x < 0, ".").otherwise(x.cast("string"))), "")
    return called.withColumn("brightest", brightest).withColumn("barcode", barcode).drop("_rounds")


def encoded(sequence: Column, table: dict[str, int], window: int = 2) -> Column:
    """STR08: colours of a base sequence by a sliding window; unknown pairs give "."; a sequence shorter than the window
    gives one "." for each base."""
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, str(v))])
    sliding = F.transform(F.sequence(F.lit(1), F.length(sequence) - (window - 1)), lambda i: F.coalesce(F.try_element_at(known, F.substring(sequence, i, F.lit(window))), F.lit(".")))
    return F.when(F.length(sequence) < window, F.repeat(F.lit("."), F.length(sequence))).otherwise(F.array_join(sliding, ""))


def decoded(colours: Column, start: str, table: dict[str, int]) -> Column:
    """STR09, STR10: bases of a colour string from a known first base; "" where no base fits.

    Raises ValueError if a base and a colour do not name one next base.
    """
    step: dict[str, str] = {}
    for pair, colour in table.items():
        if step.setdefault(f"{pair[0]}{colour}", pair[1]) != pair[1]:
            raise ValueError(f"base {pair[0]} and colour {colour} are ambiguous")
    known = F.create_map(*[F.lit(x) for k, v in step.items() for x in (k, v)])
    walk = lambda s, c: F.when(s == "", s).otherwise(F.concat(s, F.try_element_at(known, F.concat(F.substring(s, -1, 1), c))))
    digits = F.filter(F.split(colours, ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(start), lambda s, c: F.coalesce(walk(s, c), F.lit("")))


def ends_match(bases: Column, anchor: str) -> Column:
    """STR11: first and last base are the anchor's; an anchor that has not two bases is not checked."""
    if len(anchor) != 2:
        return F.lit(True)
    return (F.substring(bases, 1, 1) == anchor[0]) & (F.substring(bases, -1, 1) == anchor[1])


def with_genes(reads: DataFrame, codebook: DataFrame) -> DataFrame:
    """JON05: genes by barcode; "background" where the codebook has none. codebook: (barcode, gene)."""
    return reads.join(codebook, "barcode", "left").withColumn("in_codebook", F.col("gene").isNotNull()).fillna("background", ["gene"])


Rule = tuple[Column, Column]
# The names of rules and modes, which configurations use.
#: FLT18: spot rules by name; each makes (keep, penalty) from its parameter.
RULES: dict[str, Callable[[float], Rule]] = {
    "quality_mean_lt": lambda t: (F.col("quality") < t, F.greatest(F.col("quality") - t, F.lit(0.0))),
    "channel_margin_mean_gt": lambda t: (F.col("margin") >= t, F.greatest(t - F.col("margin"), F.lit(0.0))),
    "keep_all": lambda _: (F.lit(True), F.lit(0.0)),
}


def apply_rules(reads: DataFrame, rules: list[tuple[str, float, float]], most_penalty: float | None = None) -> DataFrame:
    """FLT19: rules (name, parameter, weight): keep is the AND of all masks and, with most_penalty, of the weighted
    penalty sum staying below it. ValueError for an unknown name."""
    if unknown := {n for n, _, _ in rules} - set(RULES):
        raise ValueError(f"no rules {sorted(unknown)}")
    made = [(*RULES[name](value), weight) for name, value, weight in rules]
    keep = reduce(lambda a, b: a & b, (k for k, _, _ in made), F.lit(True))
    penalty = reduce(lambda a, b: a + b, (p * w for _, p, w in made), F.lit(0.0))
    out = reads.withColumn("penalty", penalty).withColumn("keep", keep)
    return out if most_penalty is None else out.withColumn("keep", F.col("keep") & (F.col("penalty") <= most_penalty))


def gated(reads: DataFrame, mode: str = "pattern_first", most_quality: float = 0.5) -> DataFrame:
    """FLT20, ARR03: reads below the quality limit that match the pattern and then the codebook, or the codebook first;
    column gate says where each read stops."""
    steps = {"pattern_first": ["pattern_valid", "in_codebook"], "legacy_membership_first": ["in_codebook", "pattern_valid"]}
    if mode not in steps:
        raise ValueError(f"mode is one of {sorted(steps)}")
    first, second = steps[mode]
    gate = F.when(~F.col("valid") | (F.col("quality") >= most_quality), "quality").when(~F.col(first), first).when(~F.col(second), second).otherwise("kept")
    return reads.withColumn("gate", gate)
