"""Edge-security and traffic analytics as PySpark DataFrame operators."""
