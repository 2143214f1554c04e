"""Test-table mapping, independent SQL for every report, and the query registry."""
