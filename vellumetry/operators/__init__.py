"""DataFrame operators: tables, matching, pages, analytics, grids."""
