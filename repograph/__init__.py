"""repograph: live code-graph and agent-event analytics as Spark DataFrame operators."""
