"""Training-data operators: filtering, near-duplicates, tokens, packing, chat and media.

Nothing outside this subpackage imports it.  `catalog.queries()` and
`catalog.oracle_sql()` list the queries it contributes.
"""
