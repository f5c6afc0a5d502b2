"""statelog: versioned key/value state and transaction dependency analytics on PySpark."""
