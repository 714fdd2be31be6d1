"""noticeloom: a PySpark-native engine for analysing public programme notices."""
