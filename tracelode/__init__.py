"""Telemetry and agent-data analytics as plain DataFrame functions on Spark.

Tags in the docstrings say where a rule comes from: (I) a rule fixed by the
system whose data we analyse, (S) implied by a table or index definition,
(D) described in prose only, so the formula is ours.
"""
