"""glossa: likelihood text classification and its evaluation as Spark plans."""
