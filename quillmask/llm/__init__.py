"""Training-data operators: ten whole-corpus stages plus their registered queries (see queries.py)."""
