"""tidelog: infrastructure-log analytics as Spark DataFrame jobs."""
