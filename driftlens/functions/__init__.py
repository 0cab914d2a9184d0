"""Column functions: native expressions only, independent of the session time zone."""
