"""Report tables and their renderings."""
