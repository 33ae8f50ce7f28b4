"""Provider profiling on Spark: Firth bias-reduced logistic regression with one intercept per provider."""
