"""Reading, cleaning and writing record files."""
