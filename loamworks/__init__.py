"""A PySpark-native analytics engine for text corpora, conversation logs and Markdown-style knowledge bases."""
