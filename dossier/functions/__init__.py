"""Column expressions: everything here is composed from Spark built-ins except HTML reading."""
