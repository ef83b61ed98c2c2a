"""Column expressions shared by all operators. Nothing here runs a job."""
