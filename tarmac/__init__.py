"""tarmac — monthly on-time-performance analytics on Spark.

Every operator takes and returns DataFrames; nothing is collected to the
driver except bounded model parameters (scaler means, cut-offs per label,
fitted MLlib models).
"""

__version__ = "0.1.0"
