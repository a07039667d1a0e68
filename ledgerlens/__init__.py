"""ledgerlens: Spark-native analytics over payment transactions and support tickets."""

__version__ = "0.1.0"
