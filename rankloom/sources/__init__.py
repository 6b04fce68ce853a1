"""Readers and writers for the file layouts the operators start from."""
