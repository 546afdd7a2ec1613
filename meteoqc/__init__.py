"""PySpark operators for the quality control of weather-station time series."""
