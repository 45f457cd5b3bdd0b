"""Batch analytics jobs on PySpark: typed sources and sinks, grouped totals and
counts, word counts, tables, keyed cells, SQL previews and input contracts."""
