"""Column functions: text, numbers and units, dates, article numbers. No Python runs for rows here."""
