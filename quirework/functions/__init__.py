"""Column functions: geometry, text rules, paths and colours."""
