"""barloom: time-series research, simulation and corpus preparation on PySpark."""
