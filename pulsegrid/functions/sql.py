"""Window starts for SQL users: SELECT * FROM sliding_windows(n, length, stride)."""
from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """A SQL table function of this session: full half-open windows over n samples, from a sequence inside the engine."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION sliding_windows(n BIGINT, length BIGINT, stride BIGINT)
        RETURNS TABLE (window_index BIGINT, `start` BIGINT, `end` BIGINT)
        RETURN SELECT CAST(w AS BIGINT), w * sliding_windows.stride, w * sliding_windows.stride + sliding_windows.length
        FROM (SELECT explode(CASE WHEN sliding_windows.n >= sliding_windows.length
                             THEN sequence(0L, (sliding_windows.n - sliding_windows.length) div sliding_windows.stride) ELSE array() END) AS w)""")
