"""Sources: CSV, API pages, cached snapshots, boundaries and table adapters."""
