"""chemloom: chemical-hazard analytics and training-data jobs on Spark DataFrames."""
