"""Release-driven time series analytics on Spark: operators, panels, model fits and streams."""
