"""Resolution of raw census codes into one consistent life history per individual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Raw census codes.
RAW_ALIVE, RAW_DEAD, RAW_MISSING = 0, 1, 2


def resolve_status(
    panel: DataFrame,
    code: str = "STAT_RAW",
    out: str = "STAT",
    id_col: str = "IND_ID",
    order_col: str = "CENSUS_NUM",
) -> DataFrame:
    """Add ``out``: 1 alive, 0 dead, NULL unknown.

    A missing spell before a later sighting is alive; a missing spell never followed by a
    sighting is dead from its start; nobody comes back after a recorded death. In closed form,
    with ``first_dead`` the first recorded death, ``last_seen`` the last sighting before it and
    ``death`` the first dead-or-missing code after ``last_seen``: dead from ``death`` on, alive
    before it, unknown where the code itself is unknown before it.

    The three extrema share one exchange and one sort on (id, census); a later ``lead`` or
    ``lag`` over the same window reuses both.
    """
    life = (
        Window.partitionBy(id_col)
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    s, t = F.col(code), F.col(order_col)
    first_dead, last_seen, death = F.col("__first_dead"), F.col("__last_seen"), F.col("__death")
    return (
        panel.withColumn("__first_dead", F.min(F.when(s == RAW_DEAD, t)).over(life))
        .withColumn(
            "__last_seen",
            F.max(F.when((s == RAW_ALIVE) & (first_dead.isNull() | (t < first_dead)), t)).over(life),
        )
        .withColumn(
            "__death",
            F.min(
                F.when(s.isin(RAW_DEAD, RAW_MISSING) & (last_seen.isNull() | (t > last_seen)), t)
            ).over(life),
        )
        .withColumn(
            out,
            F.when(death.isNotNull() & (t >= death), 0).when(s.isin(RAW_ALIVE, RAW_MISSING), 1).cast("int"),
        )
        .drop("__first_dead", "__last_seen", "__death")
    )
