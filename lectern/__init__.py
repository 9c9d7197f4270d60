"""Transcript analytics on Spark: DataFrame operators, query plans and gates."""
