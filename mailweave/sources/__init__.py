"""Readers: parquet tables, mail files, request JSON, CRM exports."""
