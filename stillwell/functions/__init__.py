"""Column expressions: dates, strings, numbers, arrays and geometry. All are Spark built-ins."""
