"""Product analytics and experimentation operators on PySpark DataFrames."""
