"""A Spark-native analytics engine for Earth-observation style metadata catalogues."""
