"""Column expressions: text and HTML scans, dates, money, fixed values."""
