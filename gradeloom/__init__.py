"""gradeloom: answer evaluation and training-data preparation as Spark plans."""
