"""Tables, models and reports from and to files."""
