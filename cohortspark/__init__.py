"""Spark-native longitudinal-cohort analytics: lazy DataFrame operators over repeated observations."""
