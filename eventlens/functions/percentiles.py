"""Exact percentiles of groups of any size.

``F.percentile`` keeps every distinct value of a group in the memory of one task, which
a group holding a third of a very large table does not survive. So (group, value) pairs
are counted first, over tasks split by both. The values of a group are then laid over
ordered slots, 16,384 per e-fold of their size, by the same shuffled counts. Sums over the
slots tell which one or two of them hold the wanted ranks, and only the counts in these are
put in order. Every group goes this way, whatever its size.

One task meets the slots of a group, some 40,000 for each power of ten that its values
span, and the distinct values of one slot, which lie within 0.006 % of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

PER_EFOLD = 16_384
#: ln of the smallest double is about -744.4: this shift makes every ln positive.
LN_SHIFT = 745

# Slot numbers never fall as the value rises. Ranks count from 0: a row covers those from
# _below up to _below + _n - 1, and the wanted ones lie on either side of _pos.
_EXACT = f"""
WITH counts AS (
  SELECT _k, _num, count(_num) AS _n,
    -- never NULL: or the join below would filter one of its sides, and the counts be made twice
    coalesce(floor(signum(_num) * (least(ln(abs(nullif(_num, 0))), {LN_SHIFT}) + {LN_SHIFT}) * {PER_EFOLD}), 0) AS _slot
  FROM {{rows}} GROUP BY _k, _num
),
slots AS (
  SELECT _k, _slot, _below AS _start, _pos
  FROM (
    SELECT _k, _slot, _n, (sum(_n) OVER upward) - _n AS _below,
      ((sum(_n) OVER whole) - 1) * CAST({{fraction}} AS DOUBLE) AS _pos
    FROM (SELECT _k, _slot, sum(_n) AS _n FROM counts GROUP BY _k, _slot)
    WINDOW upward AS (PARTITION BY _k ORDER BY _slot ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY _k)
  )
  WHERE _below + _n > floor(_pos) AND _below <= ceil(_pos)
),
ranked AS (
  SELECT _k, _num, _n, _pos, _start + (sum(_n) OVER upward) - _n AS _below
  FROM counts JOIN slots USING (_k, _slot)
  WINDOW upward AS (PARTITION BY _k, _slot ORDER BY _num ROWS UNBOUNDED PRECEDING)
),
ends AS (
  SELECT _k, max(_pos - floor(_pos)) AS _x,
    max(_num) FILTER (WHERE _below <= floor(_pos) AND floor(_pos) < _below + _n) AS _v0,
    max(_num) FILTER (WHERE _below <= ceil(_pos) AND ceil(_pos) < _below + _n) AS _v1
  FROM ranked GROUP BY _k
)
SELECT _k, CASE WHEN _v0 = _v1 OR _x = 0 THEN _v0 ELSE _v0 * (1 - _x) + _v1 * _x END AS value FROM ends
"""


def exact_percentile(rows: DataFrame, fraction: float) -> DataFrame:
    """``rows(_k, _num)`` -> ``(_k, value)``, interpolated linearly between ranks.

    ``_k`` must not be NULL (a struct of the group keys never is). A group without
    any number keeps its row, with NULL as value.
    """
    return rows.sparkSession.sql(_EXACT, rows=rows, fraction=float(fraction))
