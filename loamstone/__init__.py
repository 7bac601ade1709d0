"""loamstone: a Spark-native store of claims about code and documentation, with the queries that read and maintain it."""
