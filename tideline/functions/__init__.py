"""Column functions over a panel."""
