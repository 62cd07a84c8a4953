"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  `queries.QUERIES` holds the
registered `opN_*` queries and `queries.ORACLE_SQL` their SQL forms.
"""
