"""Spark-native triage analytics over card-payment ledgers."""
