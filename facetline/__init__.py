"""Change-impact analytics over source code, expressed as Spark DataFrame queries."""
