"""DataFrame in, DataFrame out: no operator here reads or writes storage."""
