"""Spark-native semantic table annotation: every relation carries ``table_id`` and one job annotates a whole corpus."""
