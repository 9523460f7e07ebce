"""Spark-native analysis and compression of the text that flows through LLM agent conversations."""
