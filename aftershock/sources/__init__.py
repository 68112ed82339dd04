"""Tables in: schemas, normalisation of raw vendor tables, reads and writes."""
