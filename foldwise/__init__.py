"""foldwise: feature engineering, encoders, stacking and batch scoring on Spark."""
