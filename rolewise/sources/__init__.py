"""Reading and writing of bound tables, models and populations."""
