"""Road-network analytics on Spark: versioned features, spatial and graph operators."""
