"""Spark-native estate analytics: text estates in, evidence-carrying facts and graph answers out."""
