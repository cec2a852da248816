"""Operators from DataFrame to DataFrame over file rows."""
