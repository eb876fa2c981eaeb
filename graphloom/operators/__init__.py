"""Graph algorithms, lookups, mutations and versioned stores over DataFrames."""
