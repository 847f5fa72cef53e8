"""End-to-end reports and registered queries."""
