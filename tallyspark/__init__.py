"""PySpark-native engine linking ledger transactions to the evidence that supports them."""
