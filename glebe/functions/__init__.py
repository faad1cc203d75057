"""Column functions: text, dates, geography and score criteria."""
