"""DataFrame operators; tables and column names are arguments."""
