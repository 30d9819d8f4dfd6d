"""Operations of a large-scale training-data pipeline, each one a function from DataFrames to a DataFrame."""
