"""A Spark-native engine for searching technical documents and the product catalogue behind them."""
