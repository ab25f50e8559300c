"""A PySpark-native engine for curating, scoring and packaging question-answering and training text."""
