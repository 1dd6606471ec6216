import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from texelarium.functions import pixel as P
from texelarium.plans import catalog


@pytest.mark.parametrize("name", ["pack_b10g11r11", "pack_e5b9g9r9", "store_half"])
def test_stores_are_short_enough_to_compile(spark, data, name):
    """The JVM interprets methods of more than 8000 bytes for good."""
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution()
    text = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
    assert sizes and all(0 < n <= 8000 for n in sizes)


def test_half_floats_about_every_power_and_tie(spark):
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, 1e300, 65519.99, 65520.0]
    for k in range(-27, 18):
        low = high = 2.0**k
        for _ in range(4):
            values += [low, high, -low]
            low, high = math.nextafter(low, 0), math.nextafter(high, math.inf)
        values += [2.0**k * (1 + (j + 0.5) / 1024) for j in (0, 1, 2, 511, 1022, 1023)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", P.store_small_float(F.col("v"), 10, True).alias("code"))
    with np.errstate(over="ignore"):
        want = {v: int(np.float64(v).astype(np.float16).view(np.uint16)) for v in values if v}
    assert all(r["code"] == want.get(r["v"], 0) for r in df.collect())
