"""Jobs that chain operators and write their result tables."""
