"""Registered queries over the test tables and the SQL they must agree with."""
