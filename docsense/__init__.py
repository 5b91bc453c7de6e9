"""docsense: document intelligence and usage analytics as Spark DataFrame queries."""
