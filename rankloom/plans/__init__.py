"""Reports that string several operators together."""
