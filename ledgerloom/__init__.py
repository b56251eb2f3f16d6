"""Document-graph retrieval, evidence guardrails and evaluation analytics on Spark."""
