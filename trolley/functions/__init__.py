"""Column expressions: reproducible draws, array search, dates, geo cells."""
