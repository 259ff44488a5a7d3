"""Cohort analytics on Spark for outcomes that are only partly recorded."""
