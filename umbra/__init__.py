"""umbra: a PySpark-native engine for private analytics over data of two or more parties."""
