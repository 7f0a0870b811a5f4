"""stemwright: a PySpark-native engine for auditing machine-written multiple-choice questions."""
