"""A keyed-collection analytics engine whose operators are Spark DataFrame plans."""
