"""Training-data operators: one module per operator, `queries` registers them for the driver."""
