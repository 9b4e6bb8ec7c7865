"""SQL twins of fits that a query can iterate: Newton steps and matrix squaring as recursive queries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from ..models.vital import Z95
from .registry import PAIRS, PANEL

STEPS = 60


def recursive(text: str) -> str:
    """The same common tables, with recursive ones allowed."""
    return text.replace("WITH per AS", "WITH RECURSIVE per AS", 1)


def interval(estimate: str, error: str) -> str:
    return (
        f"round({estimate}, 6) AS estimate, round({error}, 6) AS std_error, "
        f"round({estimate} - {Z95} * {error}, 6) AS conf_low, round({estimate} + {Z95} * {error}, 6) AS conf_high"
    )


def newton(name: str, points: str, keys: str, weight: str, score: str, start: str) -> str:
    """Tables ``name`` (the steps) and ``name_end``: intercept ``a``, slope ``b`` and variances ``va, vb``.

    ``points`` has the keys, x, y, o and the count w; ``weight`` and ``score`` are the expected information and the
    derivative of one row in terms of y and ``eta``.
    """
    k = f"{keys}, " if keys else ""
    on = f"JOIN {points} AS p USING ({keys})" if keys else f"CROSS JOIN {points} AS p"

    def sums(source: str) -> str:
        return f"""
      SELECT {k}k, a, b, sum(w * wt) AS h00, sum(w * wt * x) AS h01, sum(w * wt * x * x) AS h11,
             sum(w * sc) AS g0, sum(w * sc * x) AS g1
      FROM (SELECT *, {weight} AS wt, {score} AS sc FROM (SELECT *, a + b * x + o AS eta FROM {source}))
      GROUP BY {k}k, a, b"""

    return f"""
{name} AS (
  SELECT {k}0 AS k, CAST({start} AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM {points}{" GROUP BY " + keys if keys else ""}
  UNION ALL
  SELECT {k}k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM ({sums(f"(SELECT * FROM {name} WHERE k < {STEPS}) AS n {on}")})),
{name}_end AS (
  SELECT {k}a, b, h11 / (h00 * h11 - h01 * h01) AS va, h00 / (h00 * h11 - h01 * h01) AS vb
  FROM ({sums(f"(SELECT * FROM {name} WHERE k = {STEPS}) AS n {on}")}))"""


POISSON = dict(weight="exp(eta)", score="y - exp(eta)", start="ln(sum(w * y) / sum(w))")
CLOGLOG = dict(
    weight="exp(2 * eta - exp(eta)) / (1 - exp(-exp(eta)))",
    score="exp(eta) * (y / (1 - exp(-exp(eta))) - 1)",
    start="ln(-ln(1 - sum(w * y) / sum(w)))",
)

GLM_POISSON = (
    recursive(PANEL)
    + """,
points AS MATERIALIZED (
  SELECT model, area, x, y, 0 AS o, count(*) AS w
  FROM (SELECT 'CONE_New' AS model, AREA AS area, HT AS x, CONE_New AS y FROM panel
        UNION ALL SELECT 'CONE_Mature', AREA, HT, CONE_Mature FROM panel)
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3, 4),"""
    + newton("fit", "points", "model, area", **POISSON)
    + f""",
terms AS (
  SELECT model, '(Intercept)' AS term, a AS e, sqrt(va) AS s FROM fit_end WHERE area = 'A0'
  UNION ALL SELECT model, 'HT', b, sqrt(vb) FROM fit_end WHERE area = 'A0'
  UNION ALL
  SELECT f.model, 'AREA[' || f.area || ']', f.a - r.a, sqrt(f.va + r.va)
  FROM fit_end f JOIN fit_end r ON r.model = f.model AND r.area = 'A0' WHERE f.area <> 'A0'
  UNION ALL
  SELECT f.model, 'HT:AREA[' || f.area || ']', f.b - r.b, sqrt(f.vb + r.vb)
  FROM fit_end f JOIN fit_end r ON r.model = f.model AND r.area = 'A0' WHERE f.area <> 'A0')
SELECT model, 'full' AS fold, term, {interval("e", "s")} FROM terms"""
)

GLM_POISSON_RECRUITS = (
    recursive(PANEL)
    + """,
counted AS (
  SELECT PLOTCODE, count(*) FILTER (WHERE COHORT = CENSUS_NUM) AS y FROM panel WHERE CENSUS_NUM = 1
  GROUP BY PLOTCODE, AREA, SITEAREA, START_DATE),
points AS MATERIALIZED (
  SELECT y, CONES1 AS c, TOPALIV1 AS x, 0 AS o, count(*) AS w FROM counted JOIN plots ON OLDCODE = PLOTCODE
  GROUP BY 1, 2, 3),
origin AS (
  SELECT 0 AS k, sum(w * c * ln(y + 0.5)) / sum(w * c * c) AS b FROM points
  UNION ALL
  SELECT k + 1, b + sum(w * c * (y - exp(b * c))) / sum(w * c * c * exp(b * c))
  FROM origin CROSS JOIN points WHERE k < """
    + str(STEPS)
    + """ GROUP BY k, b),"""
    + newton("tops", "points", "", **POISSON)
    + f""",
terms AS (
  SELECT 'CONES1' AS term, b AS e, sqrt(1 / sum(w * c * c * exp(b * c))) AS s
  FROM origin CROSS JOIN points WHERE k = {STEPS} GROUP BY b
  UNION ALL SELECT '(Intercept)', a, sqrt(va) FROM tops_end
  UNION ALL SELECT 'TOPALIV1', b, sqrt(vb) FROM tops_end)
SELECT 'NumRecruits' AS model, 'full' AS fold, term, {interval("e", "s")} FROM terms"""
)

GLM_CLOGLOG_HT = (
    recursive(PAIRS)
    + """,
points AS MATERIALIZED (
  SELECT HT AS x, Dead_next AS y, ln(CensusInterval) AS o, count(*) AS w FROM surv GROUP BY 1, 2, 3),"""
    + newton("fit", "points", "", **CLOGLOG)
    + f""",
terms AS (
  SELECT '(Intercept)' AS term, a AS e, sqrt(va) AS s FROM fit_end
  UNION ALL SELECT 'HT', b, sqrt(vb) FROM fit_end)
SELECT 'ht' AS model, 'full' AS fold, term, {interval("e", "s")} FROM terms"""
)

OLS_GRAM_ANOVA = (
    PANEL
    + """,
v1 AS (
  SELECT x1, x2, x1 * x2 AS x3, y
  FROM (SELECT HT AS x1, date_diff('day', DATE '1995-01-01', START_DATE) / 365.25 AS x2, DAH AS y
        FROM panel WHERE HT IS NOT NULL AND DAH IS NOT NULL)),
c1 AS (SELECT sum(x1 * x2) / sum(x1 * x1) AS c2, sum(x1 * x3) / sum(x1 * x1) AS c3 FROM v1),
v2 AS (SELECT x1, x2 - c2 * x1 AS z2, x3 - c3 * x1 AS z3, y FROM v1 CROSS JOIN c1),
c2 AS (SELECT sum(z2 * z3) / sum(z2 * z2) AS d FROM v2),
v3 AS (SELECT x1, z2, z3 - d * z2 AS z3, y FROM v2 CROSS JOIN c2),
s AS (
  SELECT count(*) - 3 AS dof, pow(sum(y * x1), 2) / sum(x1 * x1) AS s1, pow(sum(y * z2), 2) / sum(z2 * z2) AS s2,
         pow(sum(y * z3), 2) / sum(z3 * z3) AS s3, sum(y * y) AS total FROM v3),
r AS (SELECT *, total - s1 - s2 - s3 AS rss FROM s)
SELECT 1 AS position, 'HT' AS term, 1 AS df, round(s1, 6) AS sum_sq, round(s1 / (rss / dof), 6) AS f_value FROM r
UNION ALL SELECT 2, 'DAYS', 1, round(s2, 6), round(s2 / (rss / dof), 6) FROM r
UNION ALL SELECT 3, 'HT:DAYS', 1, round(s3, 6), round(s3 / (rss / dof), 6) FROM r
UNION ALL SELECT 4, 'Residuals', dof, round(rss, 6), NULL FROM r"""
)

SIZES = ("HT", "DAH", "WD1", "WD2")
_CELLS = list(combinations_with_replacement(range(4), 2))


def _m(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


def _components() -> str:
    """Leading eigenvectors one by one: squaring a matrix leaves the projector on its largest direction."""
    parts = [
        """,
known AS (SELECT IND_ID, CENSUS_NUM, HT, DAH, WD1, WD2 FROM panel
          WHERE COHORT = 1 AND HT IS NOT NULL AND DAH IS NOT NULL AND WD1 IS NOT NULL AND WD2 IS NOT NULL),
left0 AS MATERIALIZED (SELECT """
        + ", ".join("CAST(1 AS DOUBLE) AS " + _m(i, j) if i == j else f"corr({SIZES[i]}, {SIZES[j]}) AS {_m(i, j)}" for i, j in _CELLS)
        + " FROM known)"
    ]
    trace = "(m00 + m11 + m22 + m33)"
    for c in range(4):
        square = ", ".join(" + ".join(f"{_m(i, k)} * {_m(k, j)}" for k in range(4)) + f" AS {_m(i, j)}" for i, j in _CELLS)
        top = "greatest(m00, m11, m22, m33)"
        vector = ", ".join(
            "CASE " + " ".join(f"WHEN m{j}{j} = {top} THEN {_m(i, j)}" for j in range(4)) + f" END / sqrt({top}) AS v{i}"
            for i in range(4)
        )
        parts.append(f"""
power{c} AS (
  SELECT 0 AS k, {", ".join(f"{_m(*x)} / {trace} AS {_m(*x)}" for x in _CELLS)} FROM left{c}
  UNION ALL
  SELECT k + 1, {", ".join(f"{_m(*x)} / {trace}" for x in _CELLS)}
  FROM (SELECT k, {square} FROM power{c} WHERE k < {STEPS})),
top{c} AS MATERIALIZED (
  SELECT *, {" + ".join(f"{1 if i == j else 2} * r.{_m(i, j)} * p.{_m(i, j)}" for i, j in _CELLS)} AS value
  FROM (SELECT *, {vector} FROM power{c} WHERE k = {STEPS}) AS p CROSS JOIN (SELECT {", ".join(_m(*x) for x in _CELLS)} FROM left0) AS r),
left{c + 1} AS MATERIALIZED (SELECT {", ".join(f"l.{_m(*x)} - value * p.{_m(*x)} AS {_m(*x)}" for x in _CELLS)} FROM left{c} AS l CROSS JOIN
  (SELECT value, {", ".join(f"v{i} * v{j} AS {_m(i, j)}" for i, j in _CELLS)} FROM top{c}) AS p)""")
    return ",".join(parts)


SIZE_PCA = (
    recursive(PANEL)
    + _components()
    + "\n"
    + "\nUNION ALL ".join(
        f"SELECT 'PC{c + 1}' AS component, round(sqrt(value), 6) AS sdev, round(100 * value / 4, 6) AS variance_pct, "
        f"round(v0, 6) AS HT, round(v1, 9) AS DAH, round(v2, 6) AS WD1, round(v3, 6) AS WD2 FROM top{c}"
        for c in range(4)
    )
)

SIZE_PCA_SCORES = (
    recursive(PANEL)
    + _components()
    + """,
moments AS (SELECT """
    + ", ".join(f"avg({x}) AS a{i}, stddev_samp({x}) AS s{i}" for i, x in enumerate(SIZES))
    + """ FROM known)
SELECT IND_ID, CENSUS_NUM, """
    + ", ".join(
        "round(" + " + ".join(f"({x} - a{i}) / s{i} * top{c}.v{i}" for i, x in enumerate(SIZES)) + f", 6) AS PC{c + 1}"
        for c in range(2)
    )
    + """
FROM known CROSS JOIN moments CROSS JOIN (SELECT v0, v1, v2, v3 FROM top0) AS top0
CROSS JOIN (SELECT v0, v1, v2, v3 FROM top1) AS top1"""
)
