"""Reading, cleaning and writing event tables."""
