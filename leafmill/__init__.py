"""leafmill: document structuring over whole corpora, as PySpark DataFrame plans."""

__version__ = "0.1.0"
