"""One module per family of operators; every operator maps DataFrames to a DataFrame."""
