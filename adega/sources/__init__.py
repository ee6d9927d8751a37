"""Scans and sinks: statement CSVs, raw lines, customs tables, web pages."""
