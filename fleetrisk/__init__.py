"""Risk analytics for fleets of machine-learning model artifacts, on PySpark.

Every operator takes DataFrames keyed by ``artifact_id`` and returns a DataFrame.
Nothing here collects rows to the driver; Catalyst plans the work and executors run it.
"""
