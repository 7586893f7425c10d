"""Registered queries and the equivalent SQL they are checked against."""
