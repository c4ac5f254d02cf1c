"""A Spark-native engine for evaluating language-model outputs."""
