"""Risk adjustment, clinical code retrieval and note de-identification on Spark."""
