"""Event-study operators: DataFrame in, DataFrame out, nothing runs until the result is used."""
