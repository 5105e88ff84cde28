"""Training-data operators: one module per operator, all of them table to table.

Nothing outside this subpackage imports it.
"""
