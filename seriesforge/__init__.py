"""PySpark-native analytics for fleets of labelled time series."""
