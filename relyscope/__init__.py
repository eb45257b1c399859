"""relyscope: reliability analytics over incident and metric-anomaly tables on Spark.

Modules: ``sources`` (scans, schemas, test fixtures), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(daily rollup, page answers), ``registry`` / ``oracle`` (registered queries and
their DuckDB twins).
"""

__version__ = "0.1.0"
