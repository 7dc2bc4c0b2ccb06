"""Readers of cell grids and typed tables, and writers of tables and documents."""
