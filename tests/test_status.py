"""Status resolution on every short code sequence, against the rules written as a loop."""

import itertools

from pyspark.sql import functions as F

from cohortframe.operators.status import resolve_status


def by_rules(codes):
    """Plain statement of the rules; codes are 0 alive, 1 dead, 2 missing, None unknown."""
    s = list(codes)
    if 1 in s:
        first = s.index(1)
        s[first:] = [1] * (len(s) - first)
    for i, c in enumerate(s):
        if c == 2 and 0 in s[i + 1 :]:
            s[i] = 0
    if 2 in s:
        first = s.index(2)
        s[first:] = [1] * (len(s) - first)
    return [None if c is None else 1 - c for c in s]


def test_all_sequences_up_to_length_six(spark):
    cases = [c for n in range(1, 7) for c in itertools.product((0, 1, 2, None), repeat=n)]
    rows = [(i, k + 1, code) for i, case in enumerate(cases) for k, code in enumerate(case)]
    panel = spark.createDataFrame(rows, "IND_ID long, CENSUS_NUM int, STAT_RAW int")
    out = {}
    for r in resolve_status(panel).select("IND_ID", "CENSUS_NUM", "STAT").collect():
        out.setdefault(r["IND_ID"], {})[r["CENSUS_NUM"]] = r["STAT"]
    wrong = [
        (case, got, want)
        for i, case in enumerate(cases)
        if (got := [out[i][k + 1] for k in range(len(case))]) != (want := by_rules(case))
    ]
    assert wrong == []


def test_nobody_lives_again(spark, small):
    from pyspark.sql import Window

    from cohortframe.sources.tables import line_panel

    order = Window.partitionBy("IND_ID").orderBy("CENSUS_NUM")
    back = line_panel(spark, small).withColumn("prev", F.lag("STAT").over(order))
    assert back.filter((F.col("prev") == 0) & (F.col("STAT") == 1)).count() == 0
