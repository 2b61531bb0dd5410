"""Reading sheets and tables, and writing results."""
