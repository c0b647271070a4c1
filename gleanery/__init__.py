"""Web-inventory extraction, normalisation and entity resolution on PySpark."""
