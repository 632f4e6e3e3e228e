"""Operators over the normalised facts, all lazy DataFrame transformations.

- ``filters``: filter specifications bound to Catalyst predicates.
- ``facets``: dimension lists and single-pass filter-option facets.
- ``pivots``: cells, totals, cube cross-tabs, percentages, dense/wide grids.
- ``reports``: role resolution, shares, series, KPI cards, table cells,
  profile cards, summaries and top-N per group.
"""
