"""Jobs that chain several operators, and the shared workspace they write to."""
