"""Training-data operators: near-duplicate search, tokens, filters, sharding.

One module per operator; ``registry`` holds their named queries.  Nothing else
in the library imports this subpackage.
"""
