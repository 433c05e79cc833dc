"""Binds the operators to the tables of a test directory, one query per operator."""
