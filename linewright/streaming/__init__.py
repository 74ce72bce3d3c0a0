"""Gates applied to streaming DataFrames."""
