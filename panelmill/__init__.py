"""panelmill: analytics and forecasting over many irregular daily price series, as Spark jobs.

Every operator is a function from DataFrame to DataFrame with explicit key, date and value columns.
"""
