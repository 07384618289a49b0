"""Column functions and text, record and statistics routines."""
