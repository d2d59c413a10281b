"""Spark-native ledger reconciliation: DataFrame operators over two transaction ledgers."""
