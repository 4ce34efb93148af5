"""A PySpark-native engine that resolves messy price lists into canonical medicine keys and compares prices per unit."""
