"""Query registry: each query beside the SQL it is checked against."""
