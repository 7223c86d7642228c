"""Rules of audits and evaluations as column expressions. Constants are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a checkpoint was lost, from the first thing that could lose it.
STAGES = ("corridor_exclusion", "candidate_generation_or_pruning", "seed_lineage_exclusion", "graph_or_ranker_selection", "confidence_or_visibility_gate", "retained")


def loss_stage(expected_visible: Column, in_corridor: Column, generated: Column, selected: Column, reachable: Column, visible: Column) -> Column:
    """The stage of the tracker at which a checkpoint's event got lost; a checkpoint without one is kept where nothing is picked."""
    none = F.when(visible, "false_visible_pick").otherwise("retained_absence")
    lost = F.when(~in_corridor, STAGES[0]).when(~generated, STAGES[1]).when(~selected & ~reachable, STAGES[2]).when(~selected, STAGES[3]).when(~visible, STAGES[4]).otherwise(STAGES[5])
    return F.when(expected_visible, lost).otherwise(none)


def same_observation(a: Column, b: Column, pole_a: Column, pole_b: Column, pulse: float) -> Column:
    """Whether two runs show one event: both hidden, or within a pulse and not of opposite polarity. Null or negative samples are hidden."""
    hidden_a, hidden_b = a.isNull() | (a < 0), b.isNull() | (b < 0)
    near = (F.abs(a - b) <= pulse) & ((pole_a == 0) | (pole_b == 0) | (pole_a == pole_b))
    return F.when(hidden_a | hidden_b, hidden_a & hidden_b).otherwise(F.coalesce(near, F.lit(False)))


def guide(row: Column, left_row: Column, left: Column, right_row: Column, right: Column, base: float = 2.0, inside: float = 0.04, outside: float = 0.10, change: float = 0.50, regime: float = 7.0) -> dict[str, Column]:
    """A guide between the seeds on both sides (nulls beyond the outermost): value, uncertainty, and bounds.

    Linear between seeds that differ by a regime at most, with more doubt in the middle of a change; where they differ by more the value is
    unknown and everything between them is admissible. Held beyond the ends with growing doubt; exact at seeds.
    """
    beyond = left_row.isNull() | right_row.isNull()
    at_seed = F.coalesce(left_row == row, F.lit(False)) | F.coalesce(right_row == row, F.lit(False))
    span = F.when(right_row > left_row, right_row - left_row)
    part = (row - left_row) / span
    near = F.least(row - left_row, right_row - row)
    unknown = ~beyond & ~at_seed & (F.abs(right - left) > regime)
    line = F.when(at_seed, F.coalesce(F.when(left_row == row, left), right)).when(beyond, F.coalesce(left, right)).otherwise(left + (right - left) * part)
    doubt = F.when(at_seed, F.lit(base)).when(beyond, base + outside * F.coalesce(row - left_row, right_row - row)).otherwise(base + inside * near + F.when(unknown, 0.0).otherwise(change * F.abs(right - left) * 4 * part * (1 - part)))
    return {"guide": F.when(~unknown, line), "uncertainty": doubt, "extrapolated": beyond & ~at_seed, "ambiguous": unknown, "lower": F.when(unknown, F.least(left, right)).otherwise(line), "upper": F.when(unknown, F.greatest(left, right)).otherwise(line)}


def cohort_segment(row: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "unseeded").when(row < first, "left_tail").when(row > last, "right_tail").otherwise("bracketed")


def summarised(observations: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, n, accepted, correct, wrong, unresolved, manual, agreement, coverage, longest_wrong_m) of observations with row, accepted, correct and manual.

    A manual answer earns no credit and stays in n. The longest wrong stretch is that of neighbouring observed rows.
    """
    w = Window.partitionBy(*keys).orderBy("row")
    wrong = F.col("accepted") & ~F.col("correct")
    runs = observations.withColumn("_w", wrong).filter("_w").withColumn("_g", F.col("row") - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.count("*").alias("_n")).groupBy(*keys).agg((F.max("_n") * F.lit(step)).alias("longest_wrong_m"))
    c = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & F.col("correct")).alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if("manual").alias("manual"))
    c = c.withColumn("unresolved", F.col("n") - F.col("accepted")).withColumn("agreement", F.try_divide("correct", "accepted")).withColumn("coverage", F.col("correct") / F.col("n"))
    return c.join(runs, keys, "left").withColumn("longest_wrong_m", F.coalesce("longest_wrong_m", F.lit(0.0)))
