"""Point-in-time event studies over daily panels, written as Spark DataFrame operators."""
