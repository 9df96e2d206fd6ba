"""Training-data operators. Nothing outside this folder imports it; see queries.py for the registered queries."""
