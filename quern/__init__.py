"""quern: a Spark-native engine for a bilingual business query language."""
