"""Property-screening operators, each a DataFrame -> DataFrame function."""
