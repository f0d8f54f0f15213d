"""Security-log analytics, hybrid retrieval and corpus operations as Spark DataFrame plans."""
