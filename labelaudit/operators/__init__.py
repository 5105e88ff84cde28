"""Table-to-table operators of the label audit."""
