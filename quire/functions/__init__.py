"""Column-level functions: text keys, text units, language arguments,
query variants.  All return ``pyspark.sql.Column`` built from built-in
functions, so they stay inside whole-stage codegen."""
