"""Python data sources for array containers."""
