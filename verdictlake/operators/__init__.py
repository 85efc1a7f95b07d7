"""DataFrame to DataFrame operators, one module per stage of an evaluation."""
