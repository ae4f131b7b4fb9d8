"""DataFrame operators: many queries in one job."""
