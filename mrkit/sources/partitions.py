from __future__ import annotations

import re

from pyspark.sql import DataFrame


def spread_scan(scan: DataFrame) -> DataFrame:
    """Spreads the rows of a file scan over all cores if its partitions would leave half of the cores or more idle.

    Helps few files of few row groups whose rows are costly to process. Larger scans are left as they are, without a
    shuffle. For plain scans only: asking a plan with shuffles for its partitions would run them, so such a plan fails.
    """
    if "Exchange" in scan._jdf.queryExecution().sparkPlan().toString() or re.search(
        r"\b(Aggregate|Join|Sort|Window|Repartition)", scan._jdf.queryExecution().optimizedPlan().toString()
    ):
        raise ValueError("spread_scan takes a scan of files, without shuffles")
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan
