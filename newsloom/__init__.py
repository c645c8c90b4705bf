"""newsloom: Spark-native analytics over click logs, article catalogues and news texts."""
