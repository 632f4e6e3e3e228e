"""Plans: what the dashboards ask for, assembled from the operators.

- ``widgets``: each widget's result frame over the filtered fact.
- ``registry``: widget catalogs, stored-SQL widgets, chart-type dispatch.
- ``dashboard``: a whole dashboard for one filter selection.
- ``api``: one call per data endpoint, with size-guarded sinks.
- ``queries`` / ``oracle``: the registered queries and their SQL oracles.
- ``sinks``: payloads, export names and report writers.
"""
