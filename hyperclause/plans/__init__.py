"""Tables that the registered queries derive from the sample data, and the queries themselves."""
