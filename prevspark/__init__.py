"""PySpark-native quantification and unfolding: class prevalences of unlabelled bags."""
