"""Sales-close analytics: DataFrame-in, DataFrame-out operators for closing retail days."""
