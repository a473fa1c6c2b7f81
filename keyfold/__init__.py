"""keyfold: tabular feature engineering and stacking on Spark DataFrames."""
