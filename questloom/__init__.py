"""questloom: data work around question answering, as Spark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "rules", "sources", "streaming"]
