"""A Spark-native document-intelligence engine: regions, document graphs, tables, records, reports."""
