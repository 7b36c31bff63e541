"""DataFrame operators: lookups, text search, article blocks and
extraction, the search cascade and sampling."""
