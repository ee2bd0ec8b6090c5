"""A PySpark engine that turns recognised text from photographs of packaged goods into tables."""
