"""pairloom: Spark-native sentence-pair mining, pair features and evaluation."""
