"""Column-level helpers: everything here stays inside Catalyst expressions."""
