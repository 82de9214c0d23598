"""The metric catalogue: queries over session and star-schema tables."""
