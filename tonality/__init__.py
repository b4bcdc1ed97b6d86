"""tonality: sentiment-data work (ingest, clean, label, assemble, evaluate, report,
compare with market series) expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
