"""Places of regular-expression matches, by DataFrame functions only.

Spark has no function for the places of all matches. They follow from the
lengths of the gaps that split() leaves and of the matches themselves, by
running sums within the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths summed at once; running sums cost about n * BLOCK / 2 + (n / BLOCK)^2 / 2 steps.
BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, inclusive."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("a")),
        lambda t, x: F.struct((t["s"] + x).alias("s"), F.array_append(t["a"], t["s"] + x).alias("a")),
        lambda t: t["a"],
    )


def running_sums(lengths: Column) -> Column:
    """Running sums by blocks, so that long arrays don't take quadratic time."""

    def over(all_lengths: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: _running(F.slice(all_lengths, b * BLOCK + 1, BLOCK)))

        def joined(bs: Column) -> Column:
            ends = _running(F.transform(bs, lambda b: F.element_at(b, -1)))
            return let(
                ends,
                lambda e: F.flatten(
                    F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.when(i == 0, 0).otherwise(F.get(e, i - 1))))
                ),
            )

        return let(blocks, joined)

    return let(lengths, lambda x: F.when(F.size(x) <= BLOCK, _running(x)).otherwise(over(x)))


def matches(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points, end exclusive.

    guard: a cheaper pattern that every text with a match has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.array(F.length(g), F.length(h))))
        return let(
            running_sums(lengths),
            lambda s: F.transform(
                hits, lambda h, i: F.struct(F.get(s, 2 * i).alias("start"), F.get(s, 2 * i + 1).alias("end"), h.alias("hit"))
            ),
        )

    none = F.expr("cast(array() as array<struct<start: int, end: int, hit: string>>)")
    every = let(found, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    return every if guard is None else F.when(text.rlike(guard), every).otherwise(none)
