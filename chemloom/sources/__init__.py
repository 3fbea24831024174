"""Readers of registry files, workbooks, payloads, and writers of tables and reports."""
