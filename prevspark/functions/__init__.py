"""Column expressions: closed forms, expectation maximisation and metrics."""
