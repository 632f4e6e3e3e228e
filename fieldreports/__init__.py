"""Spark-native reporting over workforce attendance and field-activity facts.

Everything is a lazy DataFrame plan: a bound filter specification becomes
Catalyst predicates, reports are aggregations/windows over the filtered fact,
and only the final (small) report result is ever collected by a caller.
"""

__all__ = ["session"]
