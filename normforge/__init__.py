"""normforge: Spark-native normalising, mining and linking of asset and advisory data."""
