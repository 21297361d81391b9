"""assaylake: a Spark-native engine for curating and analysing bio-activity assay data."""
