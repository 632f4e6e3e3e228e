"""Operators for training-data pipelines over ``documents`` and ``pages``.

One module per operator; ``queries.py`` holds the thin registered queries
(``opN_<name>``) and the SQL of those that SQL can express.  Nothing outside
this subpackage and ``corpus_pipeline.py`` imports it.
"""
