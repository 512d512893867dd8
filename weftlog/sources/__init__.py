"""Table sources and file formats."""
