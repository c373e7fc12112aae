"""Scaling trials read off `lineitem`: size n, tokens d, quality q, and a noisy loss of a known law.

n is the quantity, d the months since January 1994 of the ship date, q = 1 - 5 * discount; the tax moves the loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import laws
from plumbline.runtime import spread

LAW = {"E": 1.7, "A": 0.9, "alpha": 0.34, "B": 1.6, "beta": 0.28}
KAPPA = 0.4


def ndq():
    return F.col("n"), F.col("d"), F.col("q")


def trials(lineitem: DataFrame) -> DataFrame:
    n, d, q = ndq()
    base = spread(lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "l_discount")).select(
        "l_orderkey", "l_linenumber", "l_tax", F.concat("l_returnflag", "l_linestatus").alias("run"),
        F.col("l_quantity").alias("n"),
        ((F.year("l_shipdate") - 1994) * 12 + F.month("l_shipdate")).cast("double").alias("d"),
        F.round(1 - 5 * F.col("l_discount"), 6).alias("q"))
    clean = laws.quality_loss("reducible_linear", LAW, n, d, q, KAPPA)
    return base.withColumn("y", clean * F.exp((F.col("l_tax") - 0.04) / 4))


TRIALS_SQL = f"""select *, ({LAW['E']} + ({LAW['A']} * n ** -{LAW['alpha']} + {LAW['B']} * d ** -{LAW['beta']}) * (1 + {KAPPA} * greatest(0.0, 1 - q)))
  * exp((l_tax - 0.04) / 4) as y from (select l_orderkey, l_linenumber, l_tax, l_returnflag || l_linestatus as run, l_quantity as n,
  ((year(l_shipdate) - 1994) * 12 + month(l_shipdate))::double as d, round(1 - 5 * l_discount, 6) as q from lineitem)"""
