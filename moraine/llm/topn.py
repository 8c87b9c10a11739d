"""The N highest rows of every group, by descending score bands.

The score range is cut into bands at quantiles of all scores. The bands are processed from
the top: rows of groups that already have their N are left out by an anti-join, the rest
are ranked exactly (score, then the tie columns) and each group takes what it still lacks.
Equal scores never straddle a band, so what a band adds is final. Every band is a filter on
the score that reaches the scan.

Repeated rows are merged on the map side, whatever their number, before anything is ranked. Ranking
keeps N rows of a group on each task before the shuffle (the engine's window group limit), so a group
that holds a third of all rows sends at most N rows a task, even if all its scores are equal or all
its rows are the same one. Groups filled by the upper bands are the frequent ones, so the lowest band,
which holds most rows, loses most of its volume before ranking. The anti-join broadcasts the
filled groups only if their written size is below spark.sql.autoBroadcastJoinThreshold.

Defined results
* null group or score: the row is left out; NaN is not defined for the score.
* rows equal in group, score and the columns asked for count once (a repeated delivery); if only the tie
  columns are equal, each of them counts and which comes first is open, so ties should tell rows apart.
* fewer than n rows: the group comes out with all it has; an empty table gives an empty result.
* further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.storage import materialize

#: Shares of the rows above which the upper bands begin; the last band takes the rest.
SHARES = (0.98, 0.85)


def band_edges(df: DataFrame, score: str, shares: tuple[float, ...] = SHARES) -> list[float]:
    """Scores at which the bands begin, descending; a mergeable sketch over all rows."""
    found = df.agg(F.percentile_approx(score, list(shares), 10_000).alias("edges")).first()["edges"] or []
    return sorted(set(found), reverse=True)


def top_n(df: DataFrame, group: str, score: str, ties: list[Column], n: int, columns: list[str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The n rows of each group with the highest score; ties go by the order of the columns in ties.

    columns are returned beside group, score and `place` (from 1); they must hold those that ties reads.
    """
    rows = df.select(*dict.fromkeys([group, score, *columns])).where(F.col(group).isNotNull() & F.col(score).isNotNull())
    edges = band_edges(rows, score, shares)
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    upper, have, picked = None, None, []
    for lower in [*edges, None]:
        band = rows
        if lower is not None:
            band = band.where(F.col(score) >= lower)
        if upper is not None:
            band = band.where(F.col(score) < upper)
        if have is not None:
            band = band.join(have.where(F.col("taken") >= n).select(group), group, "left_anti")
        # a row delivered a million times is one row on each task before the shuffle
        ranked = band.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        if have is not None:
            ranked = ranked.join(have.where(F.col("taken") < n), group, "left").withColumn("place", F.col("place") + F.coalesce("taken", F.lit(0))).where(F.col("place") <= n).drop("taken")
        if lower is not None:
            ranked = materialize(ranked, "band")
            counts = reduce(DataFrame.unionByName, [*picked, ranked]).groupBy(group).agg(F.count("*").alias("taken"))
            have = materialize(counts, "taken")
        picked.append(ranked)
        upper = lower
    return reduce(DataFrame.unionByName, picked)
