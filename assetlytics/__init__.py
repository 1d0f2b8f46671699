"""assetlytics: Spark-native asset-portfolio regression analytics.

Layout
------
sources/    table readers, the ``asset`` view, CSV/JSON/parquet sinks and contracts
functions/  Column-expression helpers and driver-side scalar distributions
operators/  profiling, KPIs, missing values, outliers, features, encoders,
            evaluation, modelling, scoring and scenario operators
plans/      registered queries (Spark side) and their DuckDB oracle SQL
streaming/  file-stream batch scoring
"""

__version__ = "0.1.0"
