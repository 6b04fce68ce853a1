"""Clinical cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import CLINICAL, SCORED, clinical, scored
from rankloom.catalog.registry import query
from rankloom.operators import aggregates as A, cohort as C, joins as J

_FLAGS = f"""{CLINICAL}, fl AS (SELECT *, coalesce(HER2 = 'positive', false) AS her2_pos, coalesce(CHR17 >= 2, false) AS chr17_pos,
  coalesce(HER2 = 'negative', false) AND NOT coalesce(CHR17 >= 2, false) AND coalesce(ER = 'negative', false)
  AND coalesce(PR = 'negative', false) AS tnbc, coalesce(JAK2_RPPA >= 0, false) AS jak2_pos FROM clinical),
  flags AS (SELECT g, her2_pos, chr17_pos, tnbc, tnbc AND BRCA_germline AS tnbc_mbrca, tnbc AND jak2_pos AS tnbc_jak2 FROM fl)"""


def _flags(t):
    return C.cohort_flags(clinical(t))


@query("agg_20_cohort_flags", f"WITH {_FLAGS} SELECT * FROM flags", num="g")
def _(t):
    return _flags(t).select("g", "her2_pos", "chr17_pos", "tnbc", "tnbc_mbrca", "tnbc_jak2")


_COLS = ["HER2", "ER", "PR", "CHR17", "BRCA_germline", "JAK2_RPPA"]
_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + (f"count(CASE WHEN {c} THEN 1 END)" if c == "BRCA_germline" else f"count({c})")
    + " AS filled, count(*) AS rows FROM clinical" for c in _COLS)


@query("agg_06_fill_rates", f"WITH {CLINICAL} {_RATES}", num="filled rows")
def _(t):
    return A.fill_rates(clinical(t).select(*_COLS))


@query("agg_07_count_where", f"""WITH {CLINICAL} SELECT ER, count(CASE WHEN CHR17 >= 1 THEN 1 END) AS chr17_pos,
  count(CASE WHEN JAK2_RPPA >= 0 THEN 1 END) AS jak2_pos, count(CASE WHEN HER2 = 'positive' THEN 1 END) AS her2_pos
  FROM clinical GROUP BY ER""", num="chr17_pos jak2_pos her2_pos")
def _(t):
    return A.count_where(clinical(t), {
        "chr17_pos": F.col("CHR17") >= 1, "jak2_pos": F.col("JAK2_RPPA") >= 0,
        "her2_pos": F.col("HER2") == "positive"}, ["ER"])


_WINS = f"""{SCORED}, k AS (SELECT DISTINCT g FROM scored), wins AS (SELECT k.g, c.i, coalesce(a.s, 0) > coalesce(b.s, 0) AS win
  FROM k CROSS JOIN (VALUES (2), (3), (4), (5), (6)) c(i) LEFT JOIN scored a ON a.g = k.g AND a.i = 1
  LEFT JOIN scored b ON b.g = k.g AND b.i = c.i)"""


@query("agg_18_cohort_share", f"""WITH {_WINS}, {_FLAGS} SELECT i, count(CASE WHEN her2_pos AND win THEN 1 END)
  / nullif(count(CASE WHEN her2_pos THEN 1 END), 0)::DOUBLE AS share FROM wins JOIN flags USING (g) GROUP BY i""",
       dbl="share", num="i")
def _(t):
    rows = J.anchor_wins(scored(t), 1, [2, 3, 4, 5, 6]).join(_flags(t), "g")
    return C.cohort_share(rows, "her2_pos", "win", ["i"])


@query("agg_19_wins_all", f"WITH {_WINS} SELECT g, bool_and(win) AS wins_all FROM wins WHERE i IN (2, 3, 4) GROUP BY g", num="g")
def _(t):
    return C.wins_all(J.anchor_wins(scored(t), 1, [2, 3, 4, 5, 6]), [2, 3, 4])


@query("agg_21_cohort_report", f"""WITH {_WINS}, {_FLAGS}, u AS (SELECT g, CAST(i AS VARCHAR) AS item, win, i <> 6 AS c FROM wins
  UNION ALL SELECT g, 'all', bool_and(win), true FROM wins WHERE i <> 6 GROUP BY g),
  r AS (SELECT item, c, count(CASE WHEN her2_pos AND win THEN 1 END) / nullif(count(CASE WHEN her2_pos THEN 1 END), 0)::DOUBLE AS h,
  count(CASE WHEN tnbc_mbrca AND win THEN 1 END) / nullif(count(CASE WHEN tnbc_mbrca THEN 1 END), 0)::DOUBLE AS m,
  count(CASE WHEN tnbc_jak2 AND win THEN 1 END) / nullif(count(CASE WHEN tnbc_jak2 THEN 1 END), 0)::DOUBLE AS j
  FROM u JOIN flags USING (g) GROUP BY item, c)
  SELECT item, h AS her2_pos, CASE WHEN c THEN m END AS tnbc_mbrca, CASE WHEN NOT c THEN j END AS tnbc_jak2 FROM r""",
       dbl="her2_pos tnbc_mbrca tnbc_jak2")
def _(t):
    return C.cohort_report(scored(t), clinical(t), 1, [2, 3, 4, 5], [6], combined_name="all")
