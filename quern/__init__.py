"""quern: language-model dataset preparation as Spark DataFrame, SQL and streaming plans."""
