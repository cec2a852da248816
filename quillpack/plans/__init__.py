"""Whole plans out of operators: packing one repository or many, the command line, and the queries."""
