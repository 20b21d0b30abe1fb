"""A Spark-native layered lake."""
