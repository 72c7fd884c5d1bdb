"""DataFrame -> DataFrame operators grouped by SURVEY section."""
