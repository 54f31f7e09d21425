"""Column expressions: signal statistics over arrays, labels and times, missing values."""
