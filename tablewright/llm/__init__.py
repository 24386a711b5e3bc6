"""Operations of a training-data pipeline, each as a Spark job over whole tables."""
