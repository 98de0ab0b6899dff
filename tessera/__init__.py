"""A Spark-native engine for text corpora: cleaning, passages, literal and vector search, chains, reports, source lifecycle."""
