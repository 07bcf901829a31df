"""transitlab: Spark-native analytics for exoplanet-candidate tables.

Layout:
  functions/  Column expressions (metrics, rules, numeric helpers)
  operators/  DataFrame -> DataFrame operators (schema, enrich, classify, ...)
  sources/    readers and driver-table fixtures
  sinks/      run-partitioned report, feature and queue writers
  plans/      end-to-end jobs composed from the operators
  streaming/  the file-drop stream
"""

__version__ = "0.1.0"
