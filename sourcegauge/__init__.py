"""Traffic-source quality analytics as Spark DataFrame transformations."""
