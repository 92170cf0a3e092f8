"""tessera: a Spark-first analytics engine over ordered records, spans and text."""
