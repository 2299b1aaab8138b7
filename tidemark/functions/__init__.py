"""Column functions: validity windows, months, phrases, Student's t."""
