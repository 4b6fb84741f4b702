"""Jobs: registered queries and drivers."""
