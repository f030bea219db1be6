"""flightline: a PySpark-native analytics engine for labelled multichannel time series."""
