"""Operators on the relations of a discussion archive."""
