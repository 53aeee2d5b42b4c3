"""Seasonal ARIMA by conditional sum of squares in numpy, its order search, and the grouped operator."""
