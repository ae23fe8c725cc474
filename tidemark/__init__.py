"""A PySpark-native search-demand analytics engine."""
