"""DataFrame operators: every function takes and returns DataFrames and lets Catalyst plan them."""
