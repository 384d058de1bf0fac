"""Reading, reshaping and storing tables."""
