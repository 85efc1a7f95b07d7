"""Suite files, the run store, exported results and scratch tables."""
