"""DataFrame operators: one function per analytic step."""
