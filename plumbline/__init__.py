"""Code-metric analytics expressed as Spark DataFrame transformations."""
