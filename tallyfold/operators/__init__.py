"""DataFrame operators: tidying, type recovery, profiling, first look, queries, shaping."""
