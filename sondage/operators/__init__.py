"""Search, ranking, index building and index upkeep over DataFrames."""
