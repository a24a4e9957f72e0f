"""Table-to-table operators, grouped by what they work on."""
