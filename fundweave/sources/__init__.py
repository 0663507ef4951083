"""Reading and cleaning of input tables, and the stored vector table."""
